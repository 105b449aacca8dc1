"""The engine's queries, by name, and the SQL that each must agree with."""

from __future__ import annotations

from tidemark.plans import q_bars, q_folds, q_positions, q_signals, q_study

_PARTS = (q_bars, q_positions, q_folds, q_study, q_signals)


def queries() -> dict:
    """Name to callable of (spark, sf_dir)."""
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
