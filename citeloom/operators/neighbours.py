"""The nearest texts of many texts by TF-IDF cosine, exactly, without a row per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.operators.retrieval import STOP_WORDS, words_of
from citeloom.staging import stage

#: Texts of one block: what a task holds at once.
BLOCK = 32_768
#: Queries that meet a block at once.
QUERIES = 256
#: A term is multiplied as a column of a matrix from this share of a block's texts on, and one by one from this number on.
OFTEN, SOME = 0.06, 24
#: Columns of a block's matrix at most.
COLUMNS = 1_024
#: Texts are looked at in this many strides for a first bound of the k-th best.
STRIDES = 32
#: Stands between two texts of one key, so that no pair of words spans them.
BREAK = "\n"


def tfidf_neighbours(docs: DataFrame, key: str, text: str, asked: Column, k: int = 25, floor: float = 0.03, max_df: float = 0.85, max_features: int = 120_000, block: int = BLOCK) -> DataFrame:
    """(q, key, score, rank): the ``k`` nearest texts of every ``asked`` one by the cosine of ``retrieval.tfidf_vectors``, above ``floor`` (and above 0), without itself.

    ``key`` is a string; equal rows count once.  Texts lie in blocks, and each block meets all
    queries, which are an array of term numbers and counts each: frequent terms by a product
    of matrices, others by their postings.  That is done in single precision, and everything
    that its error bound can't rule out is summed again in double precision, always in the
    order of terms, so equal texts have equal scores.  Ties go to the smaller key.  Each block
    gives ``k`` rows per query, of which the best remain.
    """
    toks = F.transform(F.array_sort(F.collect_set(text)), lambda t: F.array_join(F.filter(words_of(t), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)), " "))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).groupBy(key).agg(F.array_join(toks, f" {BREAK} ").alias("tokens"))
    rows = stage(rows.withColumn("asked", F.coalesce(asked, F.lit(False))), "tokens")
    n = rows.count()
    counts = rows.select("tokens").mapInArrow(_frequencies, "term string, df bigint, total bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    counts = stage(counts, "term-frequencies")
    kept = counts.where(F.col("df") <= max_df * n)
    if kept.isEmpty():
        kept = counts
    best = kept.orderBy(F.desc("total"), "term").limit(max_features).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).toArrow()  # max_features rows
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast((best["term"].to_pylist(), best["idf"].to_numpy()))
    blocks = -(-max(n, 1) // block)
    blocks = -(-max(blocks, sc.defaultParallelism) // sc.defaultParallelism) * sc.defaultParallelism
    kind = docs.schema[key].dataType.simpleString()
    vectors = rows.select(F.col(key).alias("key"), "tokens", "asked").mapInArrow(lambda b: _vectors(b, vocabulary.value[0]), f"key {kind}, asked boolean, ids array<int>, counts array<int>")
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    copies = F.concat(F.array(F.struct(own.alias("block"), F.lit(False).alias("query"))), F.when(F.col("asked"), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(i.alias("block"), F.lit(True).alias("query")))).otherwise(F.array()))
    spread = vectors.select(F.explode(copies).alias("c"), "key", "ids", "counts").select("c.block", "c.query", "key", "ids", "counts")
    spread = spread.repartitionById(blocks, "block").sortWithinPartitions("block", "query")
    found = spread.mapInArrow(lambda b: _meet(b, vocabulary.value[1], k, max(floor, 0.0)), f"q {kind}, key {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return ranked.select("q", F.col("key").alias(key), "score", "rank")


def _terms(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, term) of every word and word pair of a batch, and the terms by number."""
    lists = pc.split_pattern(tokens, " ")
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    word, names = coded.indices.to_numpy(), coded.dictionary
    real = ~pc.is_in(names, pa.array(["", BREAK])).to_numpy(zero_copy_only=False)[word] if len(word) else np.zeros(0, bool)
    pair = np.flatnonzero((row[1:] == row[:-1]) & real[1:] & real[:-1])
    codes, at = np.unique(word[pair].astype(np.int64) * len(names) + word[pair + 1], return_inverse=True)
    first, second = (names.take(pa.array(x)) for x in np.divmod(codes, max(len(names), 1)))
    terms = pa.concat_arrays([names.cast(pa.string()), pc.binary_join_element_wise(first, second, " ").cast(pa.string())])
    return np.concatenate([row[real], row[pair]]), np.concatenate([word[real], at + len(names)]), terms


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, term, terms = _terms(b["tokens"])
        both = np.sort(term.astype(np.int64) * max(b.num_rows, 1) + row)
        once = both[np.diff(both, prepend=-1) > 0] // max(b.num_rows, 1)
        df, total = np.bincount(once, minlength=len(terms)), np.bincount(term, minlength=len(terms))
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(met)), pa.array(df[met]), pa.array(total[met])], names=["term", "df", "total"])


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    known = pa.array(vocabulary, pa.string())
    for b in batches:
        row, term, terms = _terms(b["tokens"])
        number = pc.fill_null(pc.index_in(terms, known), -1).to_numpy(zero_copy_only=False)[term] if len(term) else term
        row, number = row[number >= 0], number[number >= 0]
        both, count = np.unique(row.astype(np.int64) * max(len(known), 1) + number, return_counts=True)
        row, number = np.divmod(both, max(len(known), 1))
        offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (number, count)]
        yield pa.RecordBatch.from_arrays([b["key"], b["asked"], *lists], names=["key", "asked", "ids", "counts"])


class _Block:
    """Unit vectors of texts as rows, in the order of their keys, and as postings."""

    def __init__(self, parts: list[pa.RecordBatch], idf: np.ndarray):
        rows = pa.Table.from_batches(parts).sort_by("key").combine_chunks()
        self.keys = rows["key"].to_pylist()
        n = self.n = len(self.keys)
        self.starts, self.ids, self.w = _unit(rows, idf)
        row = np.repeat(np.arange(n), np.diff(self.starts))
        by_term = np.argsort(self.ids, kind="stable")
        self.posts, self.post_w = row[by_term], self.w[by_term].astype(np.float32)
        size = np.bincount(self.ids, minlength=len(idf))
        self.at = np.concatenate([[0], np.cumsum(size)])
        often = np.argsort(-size, kind="stable")[:COLUMNS]
        often = often[size[often] > max(OFTEN * n, SOME)]
        #: of each term: its column, -1 where it is met one by one, -2 where all of its kind are met together
        self.column = np.where(size >= SOME, -1, -2)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), n), np.float32)
        held = self.column[self.ids]
        self.matrix[held[held >= 0], row[held >= 0]] = self.w[held >= 0]

    def nearest(self, asked: pa.Table, idf: np.ndarray, k: int, floor: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(query, positions, scores): the ``k`` best texts of each query."""
        starts, ids, w = _unit(asked, idf)
        row, column = np.repeat(np.arange(asked.num_rows), np.diff(starts)), self.column[ids]
        left = np.zeros((asked.num_rows, len(self.matrix)), np.float32)
        left[row[column >= 0], column[column >= 0]] = w[column >= 0]
        acc = left @ self.matrix
        low, high, single = self.at[ids], self.at[ids + 1], w.astype(np.float32)
        for i in range(asked.num_rows):
            s, own = slice(starts[i], starts[i + 1]), acc[i]
            lo, hi, kind, weight = low[s], high[s], column[s], single[s]
            one = np.flatnonzero(kind == -1)
            for a, b, x in zip(lo[one].tolist(), hi[one].tolist(), weight[one]):
                own[self.posts[a:b]] += self.post_w[a:b] * x
            few = np.flatnonzero((kind == -2) & (hi > lo))
            if len(few):
                pos = _ranges(lo[few], hi[few])
                np.add.at(own, self.posts[pos], self.post_w[pos] * np.repeat(weight[few], hi[few] - lo[few]))
        # a sum of m positive products of rounded weights is off by (m + 3) / 2**24 of itself at most, whatever its order
        slack = (np.diff(starts) + 8) / 2.0**23
        least = np.full(asked.num_rows, floor)
        wide = self.n // STRIDES
        if wide > k:
            # maxima of k + 1 disjoint sets of texts: at least so many texts reach the smallest of them, the query itself may be one
            tops = acc[:, : wide * STRIDES].reshape(asked.num_rows, STRIDES, wide).max(1)
            least = np.maximum(least, np.partition(tops, wide - k - 1, 1)[:, wide - k - 1] - slack)
        where, near = np.divmod(np.flatnonzero(acc >= (least - slack).astype(np.float32)[:, None]), self.n)
        cuts = np.searchsorted(where, np.arange(asked.num_rows + 1))
        mine = np.zeros(len(idf))
        for i, q in enumerate(asked["key"].to_pylist()):
            s, d = slice(starts[i], starts[i + 1]), near[cuts[i] : cuts[i + 1]]
            d = d[self.starts[d + 1] > self.starts[d]]
            if not len(d):
                continue
            mine[ids[s]] = w[s]
            lo, hi = self.starts[d], self.starts[d + 1]
            pos = _ranges(lo, hi)
            score = np.add.reduceat(mine[self.ids[pos]] * self.w[pos], np.concatenate([[0], np.cumsum(hi - lo)[:-1]]))
            mine[ids[s]] = 0
            first = [j for j in np.lexsort((d, -score))[: k + 1] if score[j] > floor and self.keys[d[j]] != q][:k]
            if first:
                yield q, d[first], score[first]


def _unit(rows: pa.Table, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, terms, weights) of vectors of length 1 with sublinear counts."""
    lists = rows["ids"].combine_chunks()
    ids = lists.flatten().to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
    w = (1 + np.log(rows["counts"].combine_chunks().flatten().to_numpy())) * idf[ids]
    row = np.repeat(np.arange(len(lists)), np.diff(starts))
    return starts, ids, w / np.sqrt(np.bincount(row, w * w, minlength=len(lists)))[row]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


def _meet(batches: Iterator[pa.RecordBatch], idf: np.ndarray, k: int, floor: float) -> Iterator[pa.RecordBatch]:
    """Of each block its texts come first, then the queries."""
    parts: list[pa.RecordBatch] = []
    at, held = None, None
    for batch in batches:
        number, query = batch["block"].to_numpy(), batch["query"].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(number)]):
            if a == b:
                continue
            if number[a] != at:
                at, held, parts = number[a], None, []
            piece = batch.slice(a, b - a)
            if not query[a]:
                parts.append(piece)
                continue
            if held is None and parts:
                held, parts = _Block(parts, idf), []
            for c in range(0, piece.num_rows if held else 0, QUERIES):
                out = list(held.nearest(pa.Table.from_batches([piece.slice(c, QUERIES)]), idf, k, floor))
                if out:
                    q = np.repeat(np.arange(len(out)), [len(d) for _, d, _ in out])
                    names = pa.array([x[0] for x in out], batch.schema.field("key").type)
                    keys = pa.array([held.keys[j] for _, d, _ in out for j in d], batch.schema.field("key").type)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), keys, pa.array(np.concatenate([x[2] for x in out]))], names=["q", "key", "score"])
