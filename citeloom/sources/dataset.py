"""Rows of a debate dataset: filter, cards, and a stream of new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import blank

ROW_SCHEMA = "id bigint, tag string, cite string, fullcite string, summary string, spoken string, fulltext string, markup string, pocket string, hat string, block string, side string, event string, level string, year int, duplicateCount int, tournament string, round string, opponent string, judge string, schoolName string"


def read_rows(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Dataset rows from JSON lines or Parquet with a stated schema, so nothing is inferred."""
    reader = spark.read.schema(ROW_SCHEMA)
    return (reader.json(path) if kind == "json" else spark.read.parquet(path)).withColumnRenamed("duplicateCount", "duplicatecount")


def filter_rows(rows: DataFrame, events=None, sides=None, year_min=None, year_max=None, min_duplicates=None, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with spoken text that meet the conditions; a null year or count passes.  One row per id."""
    keep = ~blank(F.col("spoken"))
    if events:
        keep &= F.col("event").isin(*events)
    if sides:
        keep &= side_of(F.col("side")).isin(*sides)
    if year_min is not None:
        keep &= F.col("year").isNull() | (F.col("year") >= year_min)
    if year_max is not None:
        keep &= F.col("year").isNull() | (F.col("year") <= year_max)
    if min_duplicates is not None:
        keep &= F.col("duplicatecount").isNull() | (F.col("duplicatecount") >= min_duplicates)
    if contains:
        keep &= F.lower(F.concat_ws(" ", "tag", "fullcite", "block", "hat")).contains(contains.lower())
    out = rows.where(keep).dropDuplicates(["id"])
    return out.limit(limit) if limit else out


def side_of(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("a", "aff", "affirmative"), "aff").when(s.isin("n", "neg", "negative"), "neg").otherwise("unknown")


def round_context(tournament: str, round_: str, opponent: str, judge: str) -> Column:
    """Tournament, round, opponent and judge that are stated; NA is not."""
    parts = []
    for name, c in (("Tournament", tournament), ("Round", round_), ("Opponent", opponent), ("Judge", judge)):
        v = F.trim(F.col(c))
        parts.append(F.when(v.isNotNull() & ~F.upper(v).isin("", "NA", "N/A"), F.concat(F.lit(f"{name}: "), v)))
    return F.concat_ws(" | ", *parts)


def to_cards(rows: DataFrame, source_id: str) -> DataFrame:
    """Dataset rows as cards of one source."""
    body = F.coalesce("fulltext", "spoken")
    path = F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in ("pocket", "hat", "block")]))
    return rows.select(
        F.substring(F.sha1(F.concat_ws("|", F.lit(source_id), F.col("id").cast("string"))), 1, 16).alias("card_id"), "tag", F.coalesce("fullcite", "cite").alias("cite_raw"), F.col("year").alias("cite_year"), body.alias("body"), F.col("spoken").alias("read_text"),
        F.round(F.length("spoken") / F.length(body), 4).alias("read_ratio"), side_of(F.col("side")).alias("side"), path.alias("path"), F.nullif(F.trim("block"), F.lit("")).alias("block"), F.nullif(F.trim("pocket"), F.lit("")).alias("pocket"), F.lit(source_id).alias("source_id"),
        F.concat(F.lit(f"{source_id}#"), F.col("id").cast("string")).alias("source_path"), F.col("id").alias("ordinal"), F.lit(False).alias("disclosed_only"), round_context("tournament", "round", "opponent", "judge").alias("round_context"),
    )
