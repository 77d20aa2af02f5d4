"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftspark.plans import case_queries, history, layer_queries, report_queries, rewrite_queries, rule_queries, scan_queries, stream_queries, text_queries, whole_queries

_MODULES = [history, rule_queries, text_queries, report_queries, layer_queries, stream_queries, rewrite_queries, scan_queries, case_queries, whole_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_queries.scan_documents(spark, sf_dir)
