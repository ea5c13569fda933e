"""All queries that this library registers by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answers, delivery, graphs, lessons, reads, textual

FAMILIES = (reads, textual, answers, lessons, delivery, graphs)

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_top8"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
