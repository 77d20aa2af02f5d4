"""Queries of the look-alike operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm.lookalike import lookalike_class_sizes, lookalike_classes, lookalike_pairs, one_form_column
from siftspark.session import spread, table

_FIELDS = ["raw", "text"]


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "scan_document").select("scan_id", *_FIELDS))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike_pairs(_scans(spark, sf_dir), "scan_id", _FIELDS)
    return pairs.select("fld", F.col("a").alias("scan_id_a"), F.col("b").alias("scan_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(_scans(spark, sf_dir), "scan_id", _FIELDS)


def p3_class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_class_sizes(_scans(spark, sf_dir), "scan_id", _FIELDS)


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _scans(spark, sf_dir)
    return scans.select("scan_id", *[one_form_column(F.col(f)).alias(f"{f}_form") for f in _FIELDS])


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_class_sizes": p3_class_sizes, "p3_forms": p3_forms}
ORACLE: dict[str, str] = {}
