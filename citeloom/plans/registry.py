"""Queries and their SQL, registered by decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the same result in DuckDB's SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cards(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct cards: re-deliveries of a card_id differ in ``ingested_at`` only, which is left out."""
    df = spark.read.parquet(f"{d}/cards.parquet")
    return df.select("card_id", *columns).distinct() if columns else df.drop("ingested_at").dropDuplicates(["card_id"])
