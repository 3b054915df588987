"""Temporary views over the tables of a folder, for users of SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import checks

TABLES = ("cards", "sources", "nodes", "relate", "ingest_jobs", "opendebate_rows", "documents")


def register(spark: SparkSession, folder: str) -> list[str]:
    """Register the tables found in ``folder`` and, with cards, the views card_facts and card_flags; returns their names."""
    names = []
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if "://" in folder or Path(path).exists():
            spark.read.parquet(path).createOrReplaceTempView(t)
            names.append(t)
    if "cards" in names:
        cards = spark.table("cards").drop("ingested_at").dropDuplicates(["card_id"])
        checks.card_facts(cards).createOrReplaceTempView("card_facts")
        flags = T.warrant_flags(*[F.col(c) for c in ("tag", "body", "read_text", "read_ratio", "cite_year")])
        cards.select("card_id", flags.alias("flags")).createOrReplaceTempView("card_flags")
        names += ["card_facts", "card_flags"]
    return names
