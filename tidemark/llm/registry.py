"""The subpackage's queries and their SQL."""

from __future__ import annotations

from tidemark.llm import op5_neighbours as op5
from tidemark.llm import op6_urls as op6
from tidemark.llm import op7_secrets as op7
from tidemark.llm import op9_substrings as op9
from tidemark.llm.op1_language import op1_language
from tidemark.llm.op2_simhash import op2_simhash
from tidemark.llm.op3_decontaminate import op3_decontaminate
from tidemark.llm.op4_packing import op4_packing
from tidemark.llm.op8_tokens import op8_tokens
from tidemark.llm.op10_toxicity import op10_toxicity


def queries() -> dict:
    """Name to callable of (spark, sf_dir)."""
    return {
        "op1_language": op1_language,
        "op2_simhash": op2_simhash,
        "op3_decontaminate": op3_decontaminate,
        "op4_packing": op4_packing,
        "op5_neighbours": op5.op5_neighbours,
        "op6_urls": op6.op6_urls,
        "op7_secrets": op7.op7_secrets,
        "op8_tokens": op8_tokens,
        "op9_substrings": op9.op9_substrings,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for those that SQL can express."""
    return {"op5_neighbours": op5.ORACLE, "op6_urls": op6.ORACLE, "op7_secrets": op7.ORACLE, "op9_substrings": op9.ORACLE}
