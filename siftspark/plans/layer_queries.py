"""Queries of decoding and tool results, which SQL can't express; their tests compare them with fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.layers import layers
from siftspark.operators.results import decisions, flattened
from siftspark.session import spread, table


def decode_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def decode_by_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers(spread(table(spark, sf_dir, "scan_document").select("scan_id", "raw")), "scan_id", "raw")
    return found.groupBy(F.array_join("chain", ">").alias("chain")).agg(F.count(F.lit(1)).alias("n"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    hooks = table(spark, sf_dir, "hook_input").select("input_id", "tool_response").dropDuplicates(["input_id"]).where("tool_response IS NOT NULL")
    return flattened(hooks, "input_id", "tool_response")


def tool_result_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision over each tool result, without masking."""
    hooks = table(spark, sf_dir, "hook_input").select("input_id", "tool_name", "tool_response").dropDuplicates(["input_id"]).where("tool_response IS NOT NULL")
    return hooks.select("input_id", decisions(F.col("tool_response"), F.col("tool_name"), F.lit(False)).alias("d")).select("input_id", "d.action", "d.delivery", "d.reason", "d.level", "d.finding_count")


def tool_result_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with personal data and secrets masked, and what is delivered."""
    hooks = table(spark, sf_dir, "hook_input").select("input_id", "tool_name", "tool_response").dropDuplicates(["input_id"]).where("tool_response IS NOT NULL")
    return hooks.select("input_id", decisions(F.col("tool_response"), F.col("tool_name"), F.lit(False), masking=True).alias("d")).select("input_id", "d.delivery", "d.reason", "d.output")


QUERIES = {"decode_layers": decode_layers, "decode_by_encoding": decode_by_encoding, "json_flatten": json_flatten, "tool_result_decision": tool_result_decision, "tool_result_masked": tool_result_masked}
ORACLE: dict[str, str] = {}
