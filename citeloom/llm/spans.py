"""Long exact spans shared between records, located by sharded Aho-Corasick automata.

Any two equal runs of ``span`` words hold the same anchor: the ``gram``-word sequence with
the smallest hash in the run.  Anchors found in one text only are dropped.  The contexts
of the rest (all runs with that anchor) go to the shard of their anchor.  There each run
whose hash recurs is compiled into an automaton once, and the contexts of all documents are
streamed through it: its hits locate every occurrence word by word, and confirm a run if
two classes have it.  Equal texts are one class (see ``classed``), and equal contexts
are looked at once.  Anchors with very many contexts
go through the same automata run by run, so that no task holds all of one.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty
from citeloom.skew import lookup_join, small_join
from citeloom.staging import stage

#: Words in an anchor.
GRAM = 8
#: Contexts of one automaton, and occurrences from which the contexts of an anchor are cut into runs (the result is the same).
SHARD_CONTEXTS, HOT_CONTEXTS = 2_000, 5_000
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts in one array, and how many each text has."""
    parts = [t.split() for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for p in parts for w in p]
    return pd.util.hash_array(flat, categorize=True) if len(flat) else np.empty(0, dtype=np.uint64), counts


def anchors_of(hashes: np.ndarray, counts: np.ndarray, span: int, gram: int):
    """(text, anchor, first run, last run) arrays: which runs of ``span`` words of each text share which anchor."""
    n = len(hashes)
    empty = np.empty(0, dtype=np.int64)
    if n < span:
        return empty, empty.astype(np.uint64), empty, empty
    grams = np.zeros(n - gram + 1, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(gram):
            grams += hashes[j : n - gram + 1 + j] * factor
            factor *= _MIX[0]
        grams = mix(grams)
    width = span - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n - span + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    runs = np.arange(n - span + 1)
    runs = runs[runs + span <= ends[owner[: n - span + 1]]]
    if not len(runs):
        return empty, empty.astype(np.uint64), empty, empty
    text, pos = owner[runs], at[runs]
    new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(runs)])) - 1
    base = (ends - counts)[text[new]]
    return text[new], grams[pos[new]], runs[new] - base, runs[last] - base


def merge_intervals(starts, ends) -> list[tuple[int, int]]:
    """Union of closed word intervals as maximal stretches of consecutive words."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


#: Letters that one automaton can tell apart (code points beyond the surrogates); from so many words on a word is two letters.
LETTERS = 0x110000 - 0xE000
_HALF = LETTERS // 2


def _spell(contexts: list[tuple]) -> tuple[list[str], int]:
    """Each context (field, words as text) as letters, and how many letters a word has.

    A word of one field has the same letters everywhere, and shares none with other fields.
    The two letters of a long alphabet come from different halves, so that no match
    begins inside a word.
    """
    number: dict[tuple, int] = {}
    coded = [[number.setdefault((f, w), len(number)) for w in c.split(" ")] for f, c in contexts]
    if len(number) <= LETTERS:
        return ["".join([chr(0xE000 + k) for k in own]) for own in coded], 1
    return ["".join([chr(0xE000 + k // _HALF) + chr(0xE000 + _HALF + k % _HALF) for k in own]) for own in coded], 2


def locate(contexts: list[tuple], low: list, high: list, span: int) -> list[list[tuple[int, int]]]:
    """For each distinct context (field, text) its stretches of words that lie in recurring runs.

    A run recurs if contexts that hold it come from two classes or more (``low`` and
    ``high``: the smallest and largest class of each context).  Runs whose hash recurs are
    compiled into an automaton, each once, from whichever context has it first; then all
    contexts are streamed through it, and its hits decide word by word where each run
    stands and whether two classes have it.
    """
    coded, width = _spell(contexts)
    hashes = [np.frombuffer(c.encode("utf-32-le"), dtype=np.uint32).reshape(-1, width) for c in coded]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    flat = np.concatenate(hashes).astype(np.uint64) if hashes else np.empty((0, 1), dtype=np.uint64)
    flat = mix(flat[:, 0] | (flat[:, -1] << np.uint64(32)))
    if len(flat) < span:
        return [[] for _ in contexts]
    runs = np.zeros(len(flat) - span + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(span):
            runs = mix(runs * _MIX[0] + flat[j : len(flat) - span + 1 + j])
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(runs)]
    at = np.flatnonzero(np.arange(len(runs)) + span <= ends[owner])
    # a run that one class alone could have is no candidate
    alone = np.array([lo == hi for lo, hi in zip(low, high)], dtype=bool)
    names, number = np.unique(runs[at], return_inverse=True)
    often = np.bincount(number, minlength=len(names)) > 1
    often[number[~alone[owner[at]]]] = True
    first = np.full(len(names), len(at), dtype=np.int64)
    np.minimum.at(first, number, np.arange(len(at)))
    begins = ends - counts
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, i in enumerate(at[first[often]]):
        c = int(owner[i])
        start = int(i - begins[c]) * width
        automaton.add_word(coded[c][start : start + span * width], k)
    if not len(automaton):
        return [[] for _ in contexts]
    automaton.make_automaton()
    kept, seen = [], {}
    for c, lo, hi in zip(coded, low, high):
        hits = list(automaton.iter(c))
        kept.append(hits)
        for _, k in hits:
            old = seen.get(k)
            seen[k] = (lo, hi) if old is None else (lo if lo < old[0] else old[0], hi if hi > old[1] else old[1])
    recurring = {k for k, (lo, hi) in seen.items() if lo != hi}
    out = []
    for hits in kept:
        last = [(end + 1) // width - 1 for end, k in hits if k in recurring]
        out.append(merge_intervals([e - span + 1 for e in last], last))
    return out


_HITS = "class bigint, field string, run string, s int, e int"
_CONTEXTS = "field string, class bigint, other bigint, anchor bigint, first int, context string"


@nonempty
def _shards(batches, span: int):
    """Locate in shards: whole anchors, about ``SHARD_CONTEXTS`` contexts at a time, in rows sorted by anchor.

    ``other`` is another class that has the context, if one is known.  A negative first word
    marks a single run that stands for all texts that have it.
    """
    held: list = []

    def flush(rows):
        # equal contexts of a field are looked at once
        distinct: dict[tuple, list] = {}
        for r in rows:
            d = distinct.setdefault((r[1], r[2]), [r[3], r[3]])
            d[0], d[1] = min(d[0], r[3]), max(d[1], r[3])
            if r[4] is not None and r[4] == r[4]:
                d[0], d[1] = min(d[0], r[4]), max(d[1], r[4])
        keys = list(distinct)
        found = dict(zip(keys, locate(keys, [d[0] for d in distinct.values()], [d[1] for d in distinct.values()], span)))
        out = []
        for r in rows:
            for a, b in found[r[1], r[2]]:
                out.append((r[3], None, None, r[5] + a, r[5] + b) if r[5] >= 0 else (r[3], r[1], r[2], 0, 0))
        return pd.DataFrame(out, columns=["class", "field", "run", "s", "e"])

    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("anchor", "field", "context", "class", "other", "first"))):
            if len(held) >= SHARD_CONTEXTS and row[0] != held[-1][0]:
                yield pa.RecordBatch.from_pandas(flush(held), schema=_HITS_SCHEMA, preserve_index=False)
                held = []
            held.append(row)
    if held:
        yield pa.RecordBatch.from_pandas(flush(held), schema=_HITS_SCHEMA, preserve_index=False)


_HITS_SCHEMA = pa.schema([("class", pa.int64()), ("field", pa.string()), ("run", pa.string()), ("s", pa.int32()), ("e", pa.int32())])
_CONTEXTS_SCHEMA = pa.schema([("field", pa.string()), ("class", pa.int64()), ("other", pa.int64()), ("anchor", pa.int64()), ("first", pa.int32()), ("context", pa.string())])


@nonempty
def _cut(batches, span: int):
    """The contexts of a text's recurring anchors; a text is looked at once however many rows have it.

    For a text that two keys have, another class is made up that has it too.
    """
    seen: set = set()
    for b in batches:
        out = []
        for f, c, t, rs, several in zip(*(b[n].to_pylist() for n in ("field", "class", "text", "runs", "several"))):
            if c in seen:
                continue
            seen.add(c)
            words = t.split()
            for r in rs:
                out.append((f, c, c ^ 1 if several else None, r["anchor"], r["first"], " ".join(words[r["first"] : r["last"] + span])))
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out) if out else [()] * 6, _CONTEXTS_SCHEMA)], schema=_CONTEXTS_SCHEMA)


def text_class(field, text):
    """A number for equal texts of a field."""
    return F.xxhash64(field, text)


def classed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with class, owners, several): equal texts of a field have one class, and different ones have not.

    ``owners``: distinct field, key, class.  ``several``: classes that two keys have.  Should
    two texts get one number, a digest tells them apart, and they get others.
    """
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("\u0001", "field", "text"), 256), 1, 24))
    rows = rows.withColumn("class", text_class("field", "text"))
    while True:
        owners = stage(rows.select("field", "key", "class", digest.alias("d")).distinct(), "owners")
        per = stage(owners.groupBy("class").agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.min("d").alias("d1"), F.max("d").alias("d2")).where("k1 <> k2 or d1 <> d2"), "several")
        clash = per.where("d1 <> d2").select("class", F.lit(True).alias("clash"))  # by chance one in 10 billion texts
        if clash.isEmpty():
            return rows, owners.drop("d"), per.select("class", F.lit(True).alias("several"))
        apart = F.xxhash64(F.lit("apart"), "class", digest)
        rows = rows.join(F.broadcast(clash), "class", "left").withColumn("class", F.when(F.col("clash"), apart).otherwise(F.col("class"))).drop("clash")


def shared_spans(records: DataFrame, field: str, key: str, text: str, span: int = 25, gram: int = GRAM) -> DataFrame:
    """(field, key, first_word, last_word): maximal stretches of words shared with another key of the same field.

    Words are the pieces between white space, counted from 0; a word is shared if it lies
    in ``span`` consecutive words that another key's text has too.  Null texts, null keys
    and texts under ``span`` words have none.  Repeated rows count once; a text repeated
    inside one record is not shared.
    """
    rows = records.select(F.col(field).alias("field"), F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    rows, owners, several = classed(rows)

    @nonempty
    def find(batches):
        for pdf in batches:
            hashes, counts = word_hashes(pdf["text"].tolist())
            t, a, first, last = anchors_of(hashes, counts, span, gram)
            salt = pd.util.hash_array(pdf["field"].to_numpy(dtype=object)) if len(pdf) else np.empty(0, dtype=np.uint64)
            with np.errstate(over="ignore"):
                a = mix(a + salt[t]) if len(t) else a
            yield pd.DataFrame({"class": pdf["class"].to_numpy()[t], "anchor": a.view(np.int64), "first": first.astype(np.int32), "last": last.astype(np.int32)})

    found = stage(rows.select("field", "class", "text").mapInPandas(find, "class bigint, anchor bigint, first int, last int"), "anchors")
    found = small_join(found, several, ["class"], "left").withColumn("several", F.coalesce("several", F.lit(False)))
    # an anchor recurs if two classes have it, or one that two keys have
    counts = found.groupBy("anchor").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.bool_or("several").alias("several"), F.count("*").alias("n"))
    recurring = stage(counts.where("lo <> hi or several").select("anchor", "n"), "recurring")
    # at most (all anchors / HOT_CONTEXTS) of them; their rows stay where they are
    hot = stage(recurring.where(F.col("n") >= HOT_CONTEXTS).select("anchor"), "hot-anchors")
    some_hot = not hot.isEmpty()
    if some_hot:
        often = found.join(F.broadcast(hot), "anchor")
        kept = often.unionByName(found.join(F.broadcast(hot), "anchor", "left_anti").join(recurring.select("anchor"), "anchor"))
    else:
        kept = found.join(recurring.select("anchor"), "anchor")
    runs = kept.groupBy("class").agg(F.collect_set(F.struct("first", "last", "anchor")).alias("runs"), F.bool_or("several").alias("several"))
    # many rows may have one text; they are spread, and each task looks at a text once
    texts = lookup_join(rows.select("field", "class", "text"), runs, ["class"])
    contexts = texts.select("field", "class", "text", "runs", "several").mapInArrow(lambda b: _cut(b, span), _CONTEXTS)
    single = None
    if some_hot:
        # contexts of a hot anchor go run by run, and equal runs meet before they are sent: they come as one row
        contexts = stage(contexts, "contexts")
        w = F.split("context", " ")
        single = contexts.join(F.broadcast(hot), "anchor").withColumn("shift", F.explode(F.sequence(F.lit(0), F.size(w) - span)))
        single = stage(single.select("field", "class", "other", (F.col("first") + F.col("shift")).alias("s"), F.array_join(F.slice(w, F.col("shift") + 1, span), " ").alias("run")), "single-runs")
        ends = single.groupBy("field", F.col("run").alias("context")).agg(F.min(F.least("class", "other")).alias("class"), F.max(F.greatest("class", "other")).alias("other"))
        distinct = ends.select("field", "class", "other", F.xxhash64("field", "context").alias("anchor"), F.lit(-1).alias("first"), "context")
        contexts = contexts.join(F.broadcast(hot), "anchor", "left_anti").select("field", "class", "other", "anchor", "first", "context").unionByName(distinct)
    hits = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _shards(b, span), _HITS)
    if single is not None:
        hits = stage(hits, "hits")
        confirmed = hits.where("run is not null").select("field", "run").distinct()
        known = lookup_join(single.select("field", "run", "class", "s"), confirmed, ["field", "run"]).select("class", "s", (F.col("s") + span - 1).alias("e"))
        hits = hits.where("run is null").select("class", "s", "e").unionByName(known)
    per = hits.groupBy("class").agg(F.collect_set(F.struct("s", "e")).alias("x"))

    @nonempty
    def unite(batches):
        for pdf in batches:
            out = []
            for c, x in zip(pdf["class"], pdf["x"]):
                got = merge_intervals([y["s"] for y in x], [y["e"] for y in x])
                out.append((c, [a for a, _ in got], [b for _, b in got]))
            yield pd.DataFrame(out, columns=["class", "starts", "ends"])

    spans = stage(per.mapInPandas(unite, "class bigint, starts array<int>, ends array<int>"), "stretches")
    out = lookup_join(owners, spans, ["class"]).select("field", "key", F.explode(F.arrays_zip("starts", "ends")).alias("x"))
    return out.select("field", F.col("key").alias(key), F.col("x.starts").alias("first_word"), F.col("x.ends").alias("last_word"))
