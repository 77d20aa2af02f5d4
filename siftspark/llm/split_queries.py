"""Queries of the splitting operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm.split import context_pieces
from siftspark.session import table


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_pieces(table(spark, sf_dir, "context_document"), table(spark, sf_dir, "model_info"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that came out in more than one piece: each has exactly one second piece."""
    return p5_pieces(spark, sf_dir).where("piece_no = 2").select("request_id", F.col("doc_no").cast("long").alias("doc_no"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}

#: The items that must be split, by the definition of cost.
ORACLE = {
    "p5_found": """
SELECT DISTINCT request_id, CAST(doc_no AS BIGINT) AS doc_no
FROM context_document JOIN model_info USING (model_id, model_version)
WHERE text IS NOT NULL AND length(text) + 2 > max_tokens
"""
}
