"""Queries of the personal information operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm.personal import masked, personal
from siftspark.session import spread, table

_FIELDS = (("hook_input", "input_id", "tool_response", True), ("scan_document", "scan_id", "raw", False))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        personal(spread(table(spark, sf_dir, tab).select(key, text)), key, text, as_json).select(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), "kind", "found")
        for tab, key, text, as_json in _FIELDS
    ]
    return parts[0].unionByName(parts[1])


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders. Only hook_input has rows sent twice, so only its texts are shuffled to have each once."""
    parts = []
    for tab, key, text, as_json in _FIELDS:
        rows = table(spark, sf_dir, tab).select(key, text)
        rows = rows.dropDuplicates([key]) if tab == "hook_input" else spread(rows)
        parts.append(rows.select(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), masked(F.col(text), as_json).alias("masked")))
    return parts[0].unionByName(parts[1])


QUERIES = {"p2_found": p2_found, "p2_masked": p2_masked}
ORACLE: dict[str, str] = {}
