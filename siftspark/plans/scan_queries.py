"""Queries of the whole scan, which SQL can't express; their tests compare them with fixtures.

The policy queries of ``rule_queries`` are its part that SQL can express: rules over the texts as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators import scan
from siftspark.operators.normalize import normalize
from siftspark.operators.policy import BALANCED, judged
from siftspark.session import spread, table


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", normalize(F.col("text")).alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_findings(_documents(spark, sf_dir), "doc_id", "text")


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each document by all detectors on all layers, under the balanced policy."""
    found = scan.scanned(_documents(spark, sf_dir), "doc_id", "text")
    verdict = found.select("doc_id", judged(F.col("findings"), F.col("trusted"), BALANCED).alias("v"))
    return verdict.select("doc_id", "v.level", "v.action", F.size("v.findings").cast("long").alias("findings"), F.size("v.suppressed").cast("long").alias("suppressed"))


QUERIES = {"normalize_text": normalize_text, "scan_findings": scan_findings, "scan_documents": scan_documents}
ORACLE: dict[str, str] = {}
