"""Operators for building training corpora. Nothing else in the library imports this subpackage."""

from tidemark.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
