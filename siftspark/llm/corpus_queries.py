"""Queries over the corpus: token ids and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftspark.llm.encode import encode_corpus
from siftspark.llm.mix import mixture, shares, sized_documents
from siftspark.session import cut_lineage, spread, table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "ids")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(sized_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))), table(spark, sf_dir, "source_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "source_target")
    mixed = mixture(sized_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))), targets)
    return shares(cut_lineage(mixed), targets)


QUERIES = {"p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
