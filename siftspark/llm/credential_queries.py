"""Queries of the credential operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm.credentials import credentials, redacted
from siftspark.session import spread, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for tab, key, text, excerpt in (("scan_document", "scan_id", "raw", False), ("finding", "finding_id", "excerpt", True)):
        found = credentials(spread(table(spark, sf_dir, tab).select(key, text)), key, text, excerpt)
        parts.append(found.select(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), "line_no", "found"))
    return parts[0].unionByName(parts[1])


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "scan_document").select(F.lit("scan_document").alias("tab"), F.col("scan_id").alias("rec_id"), redacted(F.col("raw")).alias("redacted"))
    findings = table(spark, sf_dir, "finding").dropDuplicates(["finding_id"])
    return scans.unionByName(findings.select(F.lit("finding").alias("tab"), F.col("finding_id").alias("rec_id"), redacted(F.col("excerpt"), True).alias("redacted")))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLE: dict[str, str] = {}
