"""All queries of the subpackage, by name."""

from __future__ import annotations

from siftspark.llm import corpus_queries, credential_queries, lookalike_queries, personal_queries, split_queries, subject_queries

_MODULES = [corpus_queries, credential_queries, lookalike_queries, personal_queries, split_queries, subject_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
