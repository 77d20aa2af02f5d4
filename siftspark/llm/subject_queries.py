"""Queries of the subject operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftspark.llm.subjects import corpus_composition, document_subjects, subject_mixtures
from siftspark.session import table


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in ("documents", "subject_label", "subject")]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(*_inputs(spark, sf_dir))


def p8_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_mixtures(*_inputs(spark, sf_dir))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_composition(subject_mixtures(*_inputs(spark, sf_dir), least=0.0))


QUERIES = {"p8_found": p8_found, "p8_mixtures": p8_mixtures, "p8_composition": p8_composition}
ORACLE: dict[str, str] = {}
