"""Streams: new dataset files as cards, job events as states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from citeloom.operators import store
from citeloom.sources import dataset


def dataset_stream(spark: SparkSession, folder: str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Dataset rows from files that arrive in a folder."""
    rows = spark.readStream.schema(dataset.ROW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)
    return rows.withColumnRenamed("duplicateCount", "duplicatecount")


def import_stream(spark: SparkSession, folder: str, cards_path: str, checkpoint: str, source_id: str, available_now: bool = True, **conditions) -> StreamingQuery:
    """Append the cards of arriving rows that are not there yet.

    A batch that is run again after a failure finds its cards and adds nothing.
    """

    def add(batch: DataFrame, _: int):
        cards = dataset.to_cards(dataset.filter_rows(batch, **conditions), source_id)
        table = store.read_or_none(batch.sparkSession, cards_path)
        known = cards.select("card_id").limit(0) if table is None else table.select("card_id")
        store.insert_if_absent(known, cards, "card_id").write.mode("append").parquet(cards_path)

    writer = dataset_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def job_states(events: DataFrame) -> DataFrame:
    """The last state of every job of a stream of job rows (complete output): later updates win, whatever the order they arrive in."""
    state = F.struct("updated_at", "state", "processed", "imported", "error")
    best = events.where("job_id is not null").groupBy("job_id").agg(F.max(state).alias("s"))
    return best.select("job_id", "s.state", "s.processed", "s.imported", "s.error", "s.updated_at")


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind; events later than ``late`` are left out (an addition: see the README)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")
