"""A fitted vector index on disk, used only while it belongs to the corpus."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import retrieval, store

#: Format of stored indexes; another one is fitted anew.
FORMAT = 2


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def corpus_mark(cards: DataFrame) -> str:
    r = store.fingerprint(cards, "card_id").first()
    return f"{r.n}-{r.mark}"


def fit(cards: DataFrame) -> DataFrame:
    """(card_id, term, w, idf) of all cards."""
    return retrieval.corpus_vectors(cards)


def save(vectors: DataFrame, folder: str, mark: str) -> None:
    """Write a new version and then the manifest that names it, so a reader never sees half an index."""
    spark = vectors.sparkSession
    version = uuid.uuid4().hex
    # rows of a term lie together, so that a search skips the row groups without its terms
    vectors.repartition("term").sortWithinPartitions("term").write.parquet(f"{folder}/{version}")
    # manifests are only ever added: a reader takes the newest that is whole, so there is no moment without one
    name = f"manifest-{time.time_ns():020d}.json"
    part, fs = _fs(spark, f"{folder}/.{name}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"format": FORMAT, "mark": mark, "version": version}).encode()))
    out.close()
    fs.rename(part, _fs(spark, f"{folder}/{name}")[0])


def load(spark: SparkSession, folder: str, mark: str) -> DataFrame | None:
    """The stored vectors, or None where there are none, the newest is damaged, or the corpus is another."""
    place, fs = _fs(spark, folder)
    if not fs.exists(place):
        return None
    names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(place)) if n.startswith("manifest-"))
    if not names:
        return None
    try:
        m = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/{names[-1]}").collect()))
        if m["format"] != FORMAT or m["mark"] != mark:
            return None
        found, _ = _fs(spark, f"{folder}/{m['version']}/_SUCCESS")
        return spark.read.parquet(f"{folder}/{m['version']}") if fs.exists(found) else None
    except (ValueError, KeyError, TypeError):
        return None


def current(cards: DataFrame, folder: str) -> DataFrame:
    """The index of these cards: the stored one if it fits, else fitted and stored."""
    mark = corpus_mark(cards)
    vectors = load(cards.sparkSession, folder, mark)
    if vectors is None:
        save(fit(cards), folder, mark)
        vectors = load(cards.sparkSession, folder, mark)
    return vectors
