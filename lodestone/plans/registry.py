"""Registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import analytics, answers, chunking, content, evaluation, ingestion, pins, repair, retrieval, routing, telemetry

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [retrieval, analytics, content, answers, evaluation, telemetry, pins, chunking, repair, routing, ingestion]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hydrated_top8(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}
