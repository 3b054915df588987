"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on.
HOT_ROWS = 200_000
#: Salts for a hot key.
SALTS = 32


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``left`` to ``right``, where ``right`` has one row per key and ``left`` may be skewed.

    Keys with ``hot_rows`` rows or more in ``left`` are found first (at most
    rows / hot_rows of them, so the list stays small however large the table is).
    Without any, it is a plain join.  Otherwise rows of hot keys get a random-free
    salt, and the matching rows of ``right`` are repeated once per salt.
    ``how`` is inner, left or left_semi.  Null keys match nothing.
    """
    hot = left.groupBy(*on).count().where(F.col("count") >= hot_rows).select(*on).collect()
    if not hot:
        return left.join(right, on, how)
    spark = left.sparkSession
    keys = spark.createDataFrame([tuple(r) for r in hot], left.select(*on).schema).withColumn("_hot", F.lit(True))
    keys = F.broadcast(keys)
    rest = [c for c in left.columns if c not in on]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rest]) if rest else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    marked = left.join(keys, on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(keys, on, "left").withColumn("_salt", F.explode(spread)).drop("_hot")
    return marked.join(copies, [*on, "_salt"], how).drop("_salt")


#: Rows up to which the looked-up side is sent to every task.
SMALL_ROWS = 500_000


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """``lookup_join``, but a ``right`` of at most ``most`` rows is counted and broadcast, so that ``left`` stays where it is.

    For a ``right`` that is already written out and narrow.
    """
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on, how)
    return lookup_join(left, right, on, how)
