"""All queries of the engine and their DuckDB counterparts: ``Query`` objects gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korpora.plans import augment, corpus, evaluation, glossary, mining, parsing, report, segments, sessions, terms

MODULES = (terms, corpus, segments, evaluation, sessions, glossary, mining, parsing, report, augment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
