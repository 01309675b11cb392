"""Registered queries of the flow-analytics operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import adapters, corpus_tables, flows, labels, models, stats, streams

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (flows, adapters, labels, stats, corpus_tables, models, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.align_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
