"""Queries of rewriting and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.rewrite import context_windows, mobiles, sse_events, stripped
from siftspark.operators.rules import rule_findings
from siftspark.operators.shell import shell
from siftspark.session import spread, table


def sanitize_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "kind")
    return stripped(docs, rule_findings(docs, "doc_id", "text", ("kind",)), "doc_id", "text")


def sse_event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as if each line were data of an event stream."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("data: "), x))), "\n")
    return sse_events(docs.select("doc_id", lines.alias("stream")), "doc_id", "stream").groupBy("doc_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.char_length("data")).alias("chars"))


def rf_mobiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "scan_document")).select("scan_id", F.explode(mobiles(F.col("raw"))).alias("number"))


def context_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "context_document").dropDuplicates(["request_id", "doc_no"])
    return context_windows(items.select(F.struct("request_id", "doc_no").alias("item"), "text"), "item", "text").select("item.request_id", "item.doc_no", "window_no", "start", "end", "window")


def shell_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shell(spread(table(spark, sf_dir, "scan_document").select("scan_id", "raw", "kind", "source")), "scan_id", "raw")


QUERIES = {"shell_findings": shell_findings, "sanitize_strip": sanitize_strip, "sse_event_groups": sse_event_groups, "rf_mobiles": rf_mobiles, "context_window_rows": context_window_rows}
ORACLE = {
    "context_window_rows": """WITH t AS (SELECT DISTINCT ON (request_id, doc_no) request_id, doc_no, text, length(text) AS n FROM context_document WHERE text IS NOT NULL),
w AS (SELECT *, unnest(generate_series(0, CASE WHEN n <= 512 THEN 0 ELSE CAST(ceil((n - 512) / 480) AS BIGINT) END)) AS i FROM t)
SELECT request_id, doc_no, i + 1 AS window_no, i * 480 AS "start", least(i * 480 + 512, n) AS "end", array_slice(text, i * 480 + 1, i * 480 + 512) AS "window" FROM w""",
}
