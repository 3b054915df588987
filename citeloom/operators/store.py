"""Tables that change: inserts, upserts, cascading deletes, snapshots, revisions and jobs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# States of a job that is still running.
LIVE_STATES = ("queued", "discovering", "importing", "cancelling")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(place) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(place))
    return spark.read.parquet(path) if there else None


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is new, once each; null keys are left out."""
    return incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*incoming.columns)


def latest_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Per key the row with the greatest ``order`` columns (then all others), by one aggregate without a sort of groups."""
    rest = [c for c in rows.columns if c not in key]
    tie = [c for c in rest if c not in order]
    best = F.max(F.struct(*order, *tie)).alias("b")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"b.{c}").alias(c) for c in [*order, *tie]]).select(*rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``incoming`` replaces rows of the same key."""
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def delete_sources(doomed: DataFrame, sources: DataFrame, cards: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What remains of each table after the sources in ``doomed`` (source_id) go, with their nodes, cards and edges at either end."""
    d = doomed.select("source_id").distinct()
    gone = nodes.join(d, "source_id", "left_semi").select(F.col("node_id").alias("id")).unionByName(cards.join(d, "source_id", "left_semi").select(F.col("card_id").alias("id"))).distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src_node_id"), "src_node_id", "left_anti").join(gone.withColumnRenamed("id", "dst_node_id"), "dst_node_id", "left_anti")
    return {"sources": sources.join(d, "source_id", "left_anti"), "cards": cards.join(d, "source_id", "left_anti"), "nodes": nodes.join(d, "source_id", "left_anti"), "edges": kept.select(*edges.columns)}


def mark_failure(sources: DataFrame, failures: DataFrame, now: str) -> DataFrame:
    """Set or clear (null error) the refresh failure of sources; errors are cut at 1,000 characters."""
    f = failures.select("source_id", F.substring("error", 1, 1000).alias("_e"), F.lit(True).alias("_hit"))
    rows = sources.join(f, "source_id", "left")
    at = F.when(F.col("_hit"), F.when(F.col("_e").isNotNull(), F.lit(now))).otherwise(F.col("last_refresh_failed_at"))
    err = F.when(F.col("_hit"), F.col("_e")).otherwise(F.col("last_refresh_error"))
    return rows.withColumn("last_refresh_failed_at", at).withColumn("last_refresh_error", err).select(*sources.columns)


def latest_jobs(log: DataFrame) -> DataFrame:
    """The last row of each job by time of update, with five details at most; repeats and late rows change nothing."""
    rows = log.where("job_id is not null").withColumn("details", F.slice("details", 1, 5))
    return latest_rows(rows, ["job_id"], ["updated_at"])


def recover_jobs(jobs: DataFrame, note: str = "interrupted by a restart") -> DataFrame:
    """After a restart, jobs in a live state have failed."""
    live = F.col("state").isin(*LIVE_STATES)
    return jobs.withColumn("error", F.when(live, F.coalesce("error", F.lit(note))).otherwise(F.col("error"))).withColumn("state", F.when(live, "failed").otherwise(F.col("state")))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """(n, mark): size and an order-independent mark of the distinct keys, without sorting or collecting them."""
    h = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.where(F.col(key).isNotNull()).select(key).distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("mark"))


class Snapshots:
    """Versioned tables in a folder: a version is written whole, checked, and then pointed at.

    Readers see the last good version; a failed or empty refresh leaves it as it is.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self):
        return self._path(f"{self.root}/CURRENT.json")

    def current(self) -> dict | None:
        if not self._fs.exists(self._pointer()):
            return None
        text = "\n".join(r.value for r in self.spark.read.text(str(self._pointer())).collect())
        try:
            return json.loads(text)
        except ValueError:
            return None

    def read(self, table: str) -> DataFrame:
        state = self.current()
        if state is None or table not in state["tables"]:
            raise FileNotFoundError(f"no version of {table} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{state['version']}/{table}")

    def replace(self, tables: dict[str, DataFrame], allow_empty: bool = False) -> str:
        """Write all tables as a new version and switch to it; raises and changes nothing if one is empty or fails."""
        version = uuid.uuid4().hex
        counts = {}
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{version}/{name}")
                counts[name] = self.spark.read.parquet(f"{self.root}/{version}/{name}").count()
                if not counts[name] and not allow_empty:
                    raise ValueError(f"{name} is empty")
        except Exception:
            self._fs.delete(self._path(f"{self.root}/{version}"), True)
            raise
        old = self.current() or {"tables": {}}
        carried = {t: v for t, v in old["tables"].items() if t not in counts}
        for name in carried:
            self.spark.read.parquet(f"{self.root}/{old['version']}/{name}").write.parquet(f"{self.root}/{version}/{name}")
        body = json.dumps({"version": version, "tables": carried | counts})
        temp = self._path(f"{self.root}/CURRENT.{version}")
        out = self._fs.create(temp, True)
        out.write(bytearray(body.encode()))
        out.close()
        # local file systems refuse to rename onto a file
        self._fs.delete(self._pointer(), False)
        self._fs.rename(temp, self._pointer())
        return version
