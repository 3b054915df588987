"""Evaluation passages inside a corpus, by suffix arrays over the corpus.

The corpus is read once.  Of each batch of documents a suffix array is built and stored: it
holds the suffixes that can begin a match, those whose next words all form word pairs of the
evaluation texts (no other suffix can match; the pairs are a bitmap of fixed size).  Then
the items are taken in blocks of bounded size, and every suffix of every item is
binary-searched in all stored arrays.  Hits that follow each other in both texts are one
match, so its length is the longest verbatim one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty
from citeloom.llm.spans import mix
from citeloom.llm.words import normal_words
from citeloom.staging import drop_staged, stage

#: Characters of evaluation text in one searched block.
BLOCK_CHARS = 8_000_000
#: Bits of each bitmap (16 MB), whatever the items.
BITMAP_BITS = 27
#: Words of one stored suffix array, and hits looked at together, at most (but for a single text).
ARRAY_WORDS, HITS = 2_000_000, 4_000_000


class KnownWords:
    """A set of words in a bitmap; two bits a word, so a word too many is rare and none is missing."""

    def __init__(self):
        self.bits = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)

    @staticmethod
    def _at(word: str) -> tuple[int, int]:
        n = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return n >> (64 - BITMAP_BITS), n & ((1 << BITMAP_BITS) - 1)

    def add(self, words) -> None:
        for w in words:
            for k in self._at(w):
                self.bits[k >> 3] |= 1 << (k & 7)

    def __contains__(self, word: str) -> bool:
        return all(self.bits[k >> 3] >> (k & 7) & 1 for k in self._at(word))


def numbered(words: list[str]) -> np.ndarray:
    """A number of 64 bits per word, the same everywhere."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=True)


def _pair_bits(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def short(h: np.ndarray) -> np.ndarray:
    """Half of each number, which suffixes are sorted by; never 0, which ends a text."""
    return np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def evaluation_filter(texts) -> tuple[KnownWords, np.ndarray]:
    """Words and word pairs of all items (``texts`` gives an iterator over them), in bitmaps of fixed size.

    Both are of all items, so that no result depends on the size of blocks.
    """
    known = KnownWords()
    for t in texts():
        known.add(set(normal_words(t)))
    pairs = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for t in texts():
        at = np.unique(_pair_bits(numbered(normal_words(t, known))))
        np.bitwise_or.at(pairs, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return known, pairs


class ItemIndex:
    """The suffixes of a block of items."""

    def __init__(self, items: list[tuple], least: int, known):
        self.least = least
        words, owner, offset = [], [], []
        for k, (_, text) in enumerate(items):
            own = short(numbered(normal_words(text, known)))
            words += [own, np.zeros(1, dtype=np.uint32)]
            owner.append(np.full(len(own) + 1, k))
            offset.append(np.arange(len(own) + 1))
        self.items = [i for i, _ in items]
        self.words = np.concatenate(words) if words else np.zeros(1, dtype=np.uint32)
        self.owner = np.concatenate(owner) if owner else np.zeros(1, dtype=np.int64)
        self.offset = np.concatenate(offset) if offset else np.zeros(1, dtype=np.int64)
        self.starts = runs_from(self.words > 0, least)
        self.keys = keys_at(self.words, self.starts, least)


def runs_from(good: np.ndarray, n: int) -> np.ndarray:
    """Positions from which ``n`` values in a row are true."""
    if len(good) < n:
        return np.empty(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(good)))
    return np.flatnonzero(total[n:] - total[:-n] == n)


def keys_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` words from each position as byte strings that sort like the words."""
    if not len(at):
        return np.empty(0, dtype=f"S{4 * n}")
    block = words[at[:, None] + np.arange(n)].astype(">u4")
    return np.ascontiguousarray(block).view(f"S{4 * n}").ravel()


def stretches(texts: list, known, pairs: np.ndarray, least: int):
    """(text, first word, words as numbers) of maximal stretches of ``least`` words or more whose pairs are all known."""
    parts = [normal_words(t, known) for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    h = numbered([w for p in parts for w in p])
    if len(h) < max(least, 2):
        return
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = _pair_bits(h)
    good = (pairs[at >> 3] >> (at & 7) & 1).astype(bool) & (owner[1:] == owner[:-1])
    edge = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # pairs begin .. end - 1, so words begin .. end
    long = end - begin + 1 >= least
    numbers = short(h)
    for a, b in zip(begin[long], end[long]):
        yield int(owner[a]), int(a - (ends - counts)[owner[a]]), numbers[a : b + 1]


def suffix_array(found: list, least: int) -> tuple:
    """(owners, first words, lengths, words, suffixes in order) of some stretches, as bytes where they are long."""
    words = np.concatenate([x for _, _, w in found for x in (w, np.zeros(1, dtype=np.uint32))])
    at = runs_from(words > 0, least)
    order = at[np.argsort(keys_at(words, at, least), kind="stable")].astype(np.int32)
    return [k for k, _, _ in found], [f for _, f, _ in found], [len(w) for _, _, w in found], words.tobytes(), order.tobytes()


def search_array(first: np.ndarray, length: np.ndarray, words: np.ndarray, order: np.ndarray, index: ItemIndex):
    """(stretch, item, longest match, its first word in the document, in the item): arrays, one entry per match."""
    least = index.least
    keys = keys_at(words, order, least)
    low = np.searchsorted(keys, index.keys, side="left")
    high = np.searchsorted(keys, index.keys, side="right")
    begins = np.cumsum(length + 1) - (length + 1)
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    out = []
    at = 0
    while at < len(hit):
        # whole items, about ``HITS`` hits at a time
        total = np.cumsum(count[at:])
        to = at + max(1, int(np.searchsorted(total, HITS, side="right")))
        last = index.owner[index.starts[hit[to - 1]]]
        while to < len(hit) and index.owner[index.starts[hit[to]]] == last:
            to += 1
        n = count[at:to]
        q = np.repeat(index.starts[hit[at:to]], n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = order[np.repeat(low[hit[at:to]], n) + inside].astype(np.int64)
        by = np.lexsort((p, p - q))
        p, q = p[by], q[by]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(q) != 1))))
        size = np.diff(np.concatenate((new, [len(p)]))) + least - 1
        p, q = p[new], q[new]
        stretch = np.searchsorted(begins, p, side="right") - 1
        out.append((stretch, index.owner[q], size, first[stretch] + p - begins[stretch], index.offset[q]))
        at = to
    return [np.concatenate(c) for c in zip(*out)] if out else None


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, least: int = 13) -> DataFrame:
    """Documents that contain ``least`` or more consecutive words of an item.

    One row (doc_id, item_id, longest, doc_word, item_word) per document and item, for the
    longest match (the first of equal ones): its words and where it begins.  Case,
    punctuation, spacing, line-end hyphens and invisible characters don't matter.  Null
    or empty texts, items shorter than ``least`` words and items with a null id match
    nothing; repeated items and documents give one row per id pair.  Words are compared by
    32 bits of a hash, ``least`` of them in a row.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    rows = stage(rows, "items")
    kind, own = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    schema = f"doc_id {own}, item_id {kind}, longest int, doc_word int, item_word int"
    shared = spark.sparkContext.broadcast(evaluation_filter(lambda: (r.t for r in rows.toLocalIterator())))  # two bitmaps

    @nonempty
    def build(batches):
        known, pairs = shared.value
        for pdf in batches:
            ids = pdf["doc_id"].tolist()
            held, size, out = [], 0, []
            for x in stretches(pdf["text"].tolist(), known, pairs, least):
                held.append(x)
                size += len(x[2])
                if size >= ARRAY_WORDS:
                    out.append(suffix_array(held, least))
                    held, size = [], 0
            if held:
                out.append(suffix_array(held, least))
            yield pd.DataFrame([([ids[k] for k in own], *rest) for own, *rest in out], columns=["docs", "first", "length", "words", "suffixes"])

    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    arrays = stage(corpus.mapInPandas(build, f"docs array<{own}>, first array<int>, length array<int>, words binary, suffixes binary"), "suffix-arrays")
    out = None
    for block in _blocks(rows):
        index = spark.sparkContext.broadcast(ItemIndex(block, least, shared.value[0]))

        @nonempty
        def search(batches, index=index):
            x = index.value
            for pdf in batches:
                for ids, first, length, words, order in zip(*(pdf[c] for c in ("docs", "first", "length", "words", "suffixes"))):
                    got = search_array(np.asarray(first), np.asarray(length), np.frombuffer(words, dtype=np.uint32), np.frombuffer(order, dtype=np.int32), x)
                    if got is not None:
                        yield pd.DataFrame({"doc_id": np.asarray(ids)[got[0]], "item_id": [x.items[k] for k in got[1]], "longest": got[2], "doc_word": got[3], "item_word": got[4]})

        # written out block by block, so that one block's index is held at a time
        hits = stage(arrays.mapInPandas(search, schema), "leaks")
        index.destroy()
        out = hits if out is None else out.unionByName(hits)
    drop_staged(arrays)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("longest", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.longest").alias("longest"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def _blocks(rows: DataFrame):
    """The items in lists of at most ``BLOCK_CHARS`` characters; one list is held at a time."""
    block, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if block and size + len(r.t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def remove_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents in ``leaks``; documents with a null id stay."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
