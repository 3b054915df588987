"""Records that are nearly the same text: an exact set-similarity self-join by set relations.

Texts become sets of word shingles.  An index has a posting per prefix token of each set;
its lists are sorted by size and by position in the set: blocks of sizes that cannot reach
the threshold are skipped, and of each block all entries beyond the last position that can.  Two sets are candidates if they share
``SHARED`` tokens there.  Candidate sets that are much alike form clusters, in which one
set leads and the others are kept as what they add to it and lack of it: their answers
are derived from the leader's overlap by counting their few differing tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty
from citeloom.llm.spans import mix
from citeloom.llm.words import plain_words
from citeloom.skew import lookup_join, small_join
from citeloom.staging import drop_staged, stage

#: Bits of the frequency sketch's buckets (a byte each, 64 MB whatever the corpus), and slices it is summed in.
BUCKET_BITS, SLICES = 26, 16
#: Least overlap (of the larger set) for joining a cluster, most members of one, leaders tried.
ALIKE, MOST_MEMBERS, LEADERS = 0.75, 32, 8
#: Tokens that are counted at once.
SKETCHED = 8_000_000
#: Prefix tokens that candidates must share.
SHARED = 4
#: Posting lists from this length on are cut into pieces of about this length, which are joined in pairs by many tasks.
HOT_LIST = 3_000
#: Records of exactly one text up to which all their pairs are listed; beyond, each is paired with the smallest key.
MOST_COPIES = 32
#: Members of a class of equal sets that one task pairs with others.
MEMBERS_A_TASK = 500
#: Largest size that a posting tells from others.
WIDEST = (1 << 21) - 1


def shingle_sets(texts: list, fields: list, width: int, least_words: int):
    """(row, token) arrays, sorted by both: the distinct 32-bit shingle hashes of each text, and rows that have any."""
    words = [plain_words(t) for t in texts]
    counts = np.array([len(w) if len(w) >= max(least_words, width) else 0 for w in words], dtype=np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [x for w, n in zip(words, counts) if n for x in w]
    if len(flat) < width:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32)
    h = pd.util.hash_array(flat, categorize=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    salt = pd.util.hash_array(np.array([str(f) for f in fields], dtype=object))
    grams = np.zeros(len(h) - width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
        same = owner[: len(grams)] == owner[width - 1 :]
        rows = owner[: len(grams)][same]
        grams = mix(grams[same] + salt[rows])
    key = np.unique((rows.astype(np.uint64) << np.uint64(32)) | (grams >> np.uint64(32)))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _lists(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The distinct rows, and a list array of their values (rows are sorted)."""
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.empty(0, dtype=np.int64)
    offsets = np.concatenate((starts, [len(rows)])).astype(np.int32)
    return rows[starts], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int32)))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) arrays of a column of lists, or of such lists as bytes."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_list(arr.type):
        _, offsets, values = arr.cast(pa.binary()).buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1] // 4
        return np.repeat(np.arange(len(arr)), np.diff(offsets)), np.frombuffer(values, dtype=np.uint32)[offsets[0] : offsets[-1]]
    offsets = arr.offsets.to_numpy()
    return np.repeat(np.arange(len(arr)), np.diff(offsets)), arr.flatten().to_numpy().view(np.uint32)


@nonempty
def _build(batches, width: int, least_words: int):
    for b in batches:
        rows, tokens = shingle_sets(b["text"].to_pylist(), b["field"].to_pylist(), width, least_words)
        own, sets = _lists(rows, tokens)
        starts = sets.offsets.to_numpy()[:-1]
        ids = np.empty((len(own), 2), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(2):
                ids[:, k] = mix(np.add.reduceat(mix(tokens.astype(np.uint64) + np.uint64(k << 40)), starts)) if len(own) else 0
        take = pa.array(own)
        classes = pa.array([x.tobytes() for x in ids], type=pa.binary())
        yield pa.RecordBatch.from_arrays([b["field"].take(take), b["key"].take(take), b["copy"].take(take), classes, sets], names=["field", "key", "copy", "class", "tokens"])


@nonempty
def _sketch(batches):
    """Counts of the buckets that a task touches, slice by slice."""
    per = (1 << BUCKET_BITS) // SLICES
    held: list[np.ndarray] = []

    def flush():
        at, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(at, np.arange(1, SLICES) * per)
        parts = list(zip(np.split(at, cuts), np.split(n, cuts)))
        steps = [zlib.compress(np.diff(p, prepend=0).astype(np.uint32).tobytes(), 1) for p, _ in parts]
        counts = [zlib.compress(np.minimum(c, 65535).astype(np.uint16).tobytes(), 1) for _, c in parts]
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), type=pa.int32()), pa.array(steps, type=pa.binary()), pa.array(counts, type=pa.binary())], names=["slice", "steps", "counts"])

    for b in batches:
        held.append(_flat(b["tokens"])[1] >> np.uint32(32 - BUCKET_BITS))
        if sum(map(len, held)) > SKETCHED:
            yield flush()
            held = []
    if held:
        yield flush()


@nonempty
def _sum_slices(batches):
    """The sums of each slice as one byte a bucket: exact up to 127, a logarithm beyond."""
    per = (1 << BUCKET_BITS) // SLICES
    totals: dict[int, np.ndarray] = {}
    for pdf in batches:
        for s, steps, counts in zip(pdf["slice"], pdf["steps"], pdf["counts"]):
            at = np.cumsum(np.frombuffer(zlib.decompress(steps), dtype=np.uint32)) - s * per
            if s not in totals:
                totals[s] = np.zeros(per, dtype=np.uint32)
            totals[s][at] += np.frombuffer(zlib.decompress(counts), dtype=np.uint16)
    done = []
    for s, v in totals.items():
        code = np.minimum(v, 128).astype(np.uint8)
        many = np.flatnonzero(v >= 128)
        code[many] = np.minimum(255, 128 + 5 * np.log2(v[many] / 128)).astype(np.uint8)  # as code_of
        done.append((s, zlib.compress(code.tobytes(), 1)))
    yield pd.DataFrame(done, columns=["slice", "codes"])


def frequency_codes(sets: DataFrame) -> np.ndarray:
    """One byte per bucket of tokens: how often they occur.  1 proves that a token occurs once."""
    parts = sets.select("tokens").mapInArrow(_sketch, "slice int, steps binary, counts binary").repartition(SLICES, "slice").mapInPandas(_sum_slices, "slice int, codes binary")
    out = np.zeros((SLICES, (1 << BUCKET_BITS) // SLICES), dtype=np.uint8)
    for r in parts.toLocalIterator():  # SLICES rows
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["codes"]), dtype=np.uint8)
    return out.ravel()


def code_of(count: int) -> int:
    """The byte of a bucket with so many tokens."""
    return int(count if count < 128 else min(255, 128 + 5 * np.log2(count / 128)))


def _ranked(rows, tokens, code):
    """Rows and tokens, the tokens of each row from rare to frequent."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (code.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64))
    return (key >> np.uint64(40)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _tokens_of(b, codes):
    """(rows, tokens, code, size and number of lone tokens per row) of a batch of sets."""
    rows, tokens = _flat(b["tokens"])
    code = codes[tokens >> np.uint32(32 - BUCKET_BITS)]
    n = len(b["tokens"])
    return rows, tokens, code, np.bincount(rows, minlength=n), np.bincount(rows[code == 1], minlength=n)


@nonempty
def _postings(batches, codes, least: float):
    """(token, cid, place): the prefix of each set, with its size and the token's place in one number.

    Tokens are ordered from rare to frequent.  Those that occur once come first and have no
    posting; a set with so many of them that no other can reach ``least`` has none at all.
    """
    for b in batches:
        rows, tokens, code, size, lone = _tokens_of(b, codes)
        keep = (code != 1) & (size - lone >= np.ceil(least * size - 1e-9))[rows]
        rows, tokens = _ranked(rows[keep], tokens[keep], code[keep])
        starts = np.searchsorted(rows, np.arange(len(size)))
        place = np.arange(len(rows)) - starts[rows] + lone[rows]
        keep = place < (size - np.ceil(least * size - 1e-9) + SHARED)[rows]
        rows, place = rows[keep], place[keep]
        # sizes beyond 21 bits count as the largest, and their tokens as first, so that no bound is too tight
        wide = size[rows] >= WIDEST
        packed = (np.minimum(size[rows], WIDEST) << 21) | np.where(wide, 0, np.minimum(place, WIDEST))
        often = codes[tokens[keep] >> np.uint32(32 - BUCKET_BITS)] >= code_of(HOT_LIST)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int32)), pa.array(b["cid"].to_numpy()[rows]), pa.array(packed), pa.array(often)], names=["token", "cid", "packed", "often"])


@nonempty
def _order(batches, codes):
    """Tokens of each set from rare to frequent without those that occur once, and a key under which alike sets are likely to meet.

    ``size`` counts all tokens.
    """
    for b in batches:
        rows, tokens, code, size, lone = _tokens_of(b, codes)
        keep = code != 1
        rows, tokens = _ranked(rows[keep], tokens[keep], code[keep])
        if not len(rows):
            continue
        own, ordered = _lists(rows, tokens)
        with np.errstate(over="ignore"):
            meet = np.minimum.reduceat(mix(tokens.astype(np.uint64)), np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))))
        arrays = [pa.array(meet.view(np.int64)), b["cid"].take(pa.array(own)), b["class"].take(pa.array(own)), pa.array(size[own].astype(np.int32)), ordered]
        yield pa.RecordBatch.from_arrays(arrays, names=["meet", "cid", "class", "size", "tokens"])


_INTS = pa.list_(pa.int32())
_SCHEMA = pa.schema([("cluster", pa.int64()), ("leader", _INTS), ("classes", pa.list_(pa.binary())), ("cids", pa.list_(pa.int64())), ("sizes", _INTS), ("adds", pa.list_(_INTS)), ("lacks", pa.list_(_INTS))])
_CLUSTERS = "cluster bigint, leader array<int>, classes array<binary>, cids array<bigint>, sizes array<int>, adds array<array<int>>, lacks array<array<int>>"


def _cluster_run(run: list) -> list[dict]:
    """Clusters of the sets (cid, class, size, tokens) that met under one key."""
    clusters: list[dict] = []
    for cid, cls, size, tokens in run:
        own = set(tokens)
        home = None
        for c in clusters[-LEADERS:]:
            if len(c["classes"]) < MOST_MEMBERS and len(own & c["set"]) >= ALIKE * max(size, c["sizes"][0]):
                home = c
                c["adds"].append([t for t in tokens if t not in c["set"]])
                c["lacks"].append([t for t in c["leader"] if t not in own])
                break
        if home is None:
            home = {"leader": tokens, "set": own, "classes": [], "cids": [], "sizes": [], "adds": [[]], "lacks": [[]]}
            clusters.append(home)
        home["classes"].append(cls)
        home["cids"].append(cid)
        home["sizes"].append(size)
    return clusters


@nonempty
def _cluster(batches):
    """Clusters of sets, in rows sorted by the key they meet under."""
    at, run = None, []

    def rows(done):
        for c in done:
            c["cluster"] = c["cids"][0]
        return pa.RecordBatch.from_pydict({f.name: [c[f.name] for c in done] for f in _SCHEMA}, schema=_SCHEMA)

    for b in batches:
        done = []
        for key, cid, cls, size, tokens in zip(*(b[n].to_pylist() for n in ("meet", "cid", "class", "size", "tokens"))):
            # a key under which very many sets meet is cut: clusters may be formed in any way
            if key != at or len(run) >= 512:
                done += _cluster_run(run)
                at, run = key, []
            run.append((cid, cls, size, tokens))
        yield rows(done)
    if run:
        yield rows(_cluster_run(run))


def block_pairs(size_a, place_a, size_b, bound_key, starts, stops, least: float, first=None):
    """For entries of size ``size_a`` and place ``place_a`` against blocks of entries of one size, sorted by place.

    A token counts for a pair if it lies in both sets' prefixes for the overlap that this
    pair needs; such a pair shares ``SHARED`` of them or more.  So of a block the entries
    up to one place count and the rest is skipped, or none do.  ``bound_key`` gives the
    place in the list where a block's entries reach a given place; ``starts`` and ``stops``
    delimit blocks, ``first`` the entries from which on they count.  Returns (entry, place
    in the list, worth) arrays: for sets too small to share that many, tokens count more.
    """
    overlap = np.ceil(least / (1 + least) * (size_a + size_b) - 1e-9)
    need = np.minimum(SHARED, overlap)
    low = starts if first is None else np.maximum(starts, first)
    high = np.minimum(bound_key(np.maximum(size_b - overlap + need, 0).astype(np.int64)), stops)
    count = np.where(place_a < size_a - overlap + need, np.maximum(high - low, 0), 0)
    entry = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return entry, at, np.ceil(SHARED / need).astype(np.int64)[entry]


def _summed(left: list, right: list, worth: list):
    """Distinct pairs, smaller first, with the sum of their worth."""
    if not sum(map(len, left)):
        return (np.empty(0, dtype=np.int64),) * 3
    a, b, w = np.concatenate(left), np.concatenate(right), np.concatenate(worth)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[new], b[new], np.add.reduceat(w, new)


def join_lists(token: np.ndarray, cid: np.ndarray, size: np.ndarray, place: np.ndarray, least: float):
    """(a, b, shared) of pairs in posting lists sorted by token, size and place.

    The entries of one token and size are a block.  Every entry walks from block to block
    until sizes are too large for ``least``: the rest of the list is skipped.  In each block
    it takes the entries up to the last place that counts, found by binary search.
    """
    n = len(token)
    if not n:
        return (np.empty(0, dtype=np.int64),) * 3
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (size[1:] != size[:-1])))
    starts = np.flatnonzero(new)
    stops = np.concatenate((starts[1:], [n]))
    block = np.cumsum(new) - 1
    key = (block.astype(np.int64) << 22) | place
    left, right, worth = [], [], []
    at = np.arange(n)
    k = 0
    while True:
        at = at[block[at] + k < len(starts)]
        b = block[at] + k
        alive = (token[at] == token[starts[b]]) & (size[at] >= least * size[starts[b]] - 1e-9)
        at, b = at[alive], b[alive]
        if not len(at):
            break
        entry, to, w = block_pairs(size[at], place[at], size[starts[b]], lambda bound, b=b: np.searchsorted(key, (b.astype(np.int64) << 22) | np.minimum(bound, WIDEST)), starts[b], stops[b], least, at + 1 if k == 0 else None)
        left.append(cid[at[entry]])
        right.append(cid[to])
        worth.append(w)
        k += 1
    return _summed(left, right, worth)


@nonempty
def _join_lists(batches, least: float):
    """Pairs of sets with the number of prefix tokens they share, from postings sorted by token and packed sizes."""
    held: list[np.ndarray] = []

    def flush(token, cid, packed):
        a, b, shared = join_lists(token, cid, packed >> 21, packed & WIDEST, least)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared.astype(np.int32))], names=["c1", "c2", "shared"])

    size = 0
    for b in batches:
        held.append([b[n].to_numpy(zero_copy_only=False) for n in ("token", "cid", "packed")])
        size += b.num_rows
        if size < 500_000:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last list may go on
        if cut:
            yield flush(*[c[:cut] for c in cols])
        held = [[c[cut:] for c in cols]]
        size = len(cols[0]) - cut
    if held:
        yield flush(*[np.concatenate(c) for c in zip(*held)])


def _member_overlap(base: int, adds, lacks, other: set) -> int:
    """Overlap of a member with a set, from its leader's overlap."""
    return base + sum(t in other for t in adds) - sum(t in other for t in lacks)


def compare_clusters(l1: set, sizes1, adds1, lacks1, l2: set, sizes2, adds2, lacks2, least: float, within: bool = False):
    """(i, j, Jaccard) of the members of two clusters (or of one, i < j) that reach ``least``."""
    base = len(l1) if within else len(l1 & l2)
    out = []
    for i, (n1, a, d) in enumerate(zip(sizes1, adds1, lacks1)):
        first = _member_overlap(base, a, d, l2)
        plus, minus = set(a), set(d)
        for j in range(i + 1 if within else 0, len(adds2)):
            a2, d2, n2 = adds2[j], lacks2[j], sizes2[j]
            if min(n1, n2) < least * max(n1, n2) - 1e-9:
                continue
            both = first
            for t in a2:
                both += (t in l1 and t not in minus) or t in plus
            for t in d2:
                both -= (t in l1 and t not in minus) or t in plus
            if both >= least * (n1 + n2 - both) - 1e-9:
                out.append((i, j, both / (n1 + n2 - both)))
    return out


@nonempty
def _verify(batches, least: float):
    known: dict[int, set] = {}
    for pdf in batches:
        if len(known) > 2_000:
            known.clear()
        out = []
        for r in pdf.itertuples(index=False):
            l1 = known.get(r.c1)
            if l1 is None:
                l1 = known[r.c1] = set(r.leader1.tolist())
            l2 = known.get(r.c2)
            if l2 is None:
                l2 = known[r.c2] = set(r.leader2.tolist())
            for i, j, s in compare_clusters(l1, r.sizes1, r.adds1, r.lacks1, l2, r.sizes2, r.adds2, r.lacks2, least):
                a, b = r.classes1[i], r.classes2[j]
                out.append((min(a, b), max(a, b), s))
        yield pd.DataFrame(out, columns=["a", "b", "jaccard"])


@nonempty
def _verify_within(batches, least: float):
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            own = set(r.leader.tolist())
            for i, j, s in compare_clusters(own, r.sizes, r.adds, r.lacks, own, r.sizes, r.adds, r.lacks, least, within=True):
                a, b = r.classes[i], r.classes[j]
                out.append((min(a, b), max(a, b), s))
        yield pd.DataFrame(out, columns=["a", "b", "jaccard"])


def _join_hot(posts: DataFrame, least: float) -> DataFrame:
    """(c1, c2, shared) from the lists of frequent tokens, cut into pieces that meet in pairs.

    A piece has up to about ``HOT_LIST`` entries of one size.  Pieces meet only if their sizes
    and smallest places leave a pair possible, so most of a list is skipped by looking at
    its pieces, and every two pieces are joined in whichever task has room.
    """
    rows = posts.select("token", "cid", F.shiftright("packed", 21).cast("int").alias("n"), F.col("packed").bitwiseAND(WIDEST).cast("int").alias("p"))
    salts = F.broadcast(rows.groupBy("token", "n").agg(F.ceil(F.count("*") / HOT_LIST).cast("int").alias("salts")).where("salts > 1"))
    rows = rows.join(salts, ["token", "n"], "left").withColumn("salt", F.pmod(F.xxhash64("cid"), F.coalesce("salts", F.lit(1))).cast("int"))
    pieces = stage(rows.groupBy("token", "n", "salt").agg(F.min("p").alias("least_p"), F.array_sort(F.collect_list(F.struct("p", "cid"))).alias("e")), "pieces")
    names = pieces.select("token", "n", "salt", "least_p")
    other = names.select("token", *[F.col(c).alias(c + "_") for c in ("n", "salt", "least_p")])
    overlap = F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("n_")) - 1e-9)
    need = F.least(F.lit(SHARED), overlap)
    once = (F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("salt") <= F.col("salt_")))
    fits = once & (F.col("n") >= least * F.col("n_") - 1e-9) & (F.col("least_p") < F.col("n") - overlap + need) & (F.col("least_p_") < F.col("n_") - overlap + need)
    meet = names.join(other, "token").where(fits).select("token", "n", "salt", "n_", "salt_")
    # the tokens of pieces are few and frequent: what meets is spread by both ends
    both = meet.join(pieces.select("token", "n", "salt", "e"), ["token", "n", "salt"]).join(pieces.select("token", *[F.col(c).alias(c + "_") for c in ("n", "salt", "e")]), ["token", "n_", "salt_"])
    rows = both.select("n", "salt", F.col("e.cid").alias("a"), F.col("e.p").alias("pa"), "n_", "salt_", F.col("e_.cid").alias("b"), F.col("e_.p").alias("pb"))
    return rows.mapInPandas(lambda b: _join_pieces(b, least), "c1 bigint, c2 bigint, shared int")


@nonempty
def _join_pieces(batches, least: float):
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            a, pa_, b, pb = np.asarray(r.a), np.asarray(r.pa), np.asarray(r.b), np.asarray(r.pb)
            size_a, size_b = np.full(len(a), r[0]), np.full(len(a), r[4])
            zero = np.zeros(len(a), dtype=np.int64)
            same = r[0] == r[4] and r[1] == r[5]
            entry, to, w = block_pairs(size_a, pa_, size_b, lambda bound: np.searchsorted(pb, bound), zero, zero + len(b), least, np.arange(len(a)) + 1 if same else None)
            yield pd.DataFrame(dict(zip(("c1", "c2", "shared"), _summed([a[entry]], [b[to]], [w]))))


def _candidates(posts: DataFrame, least: float) -> DataFrame:
    """(c1, c2), c1 < c2: sets that share enough prefix tokens; ``posts`` marks tokens that may have long lists."""
    posts = stage(posts, "postings")
    long = stage(posts.where("often").groupBy("token").count().where(F.col("count") >= HOT_LIST).select("token"), "long")
    hot = not long.isEmpty()
    posts_ = posts.drop("often")
    usual = posts_.join(F.broadcast(long), "token", "left_anti") if hot else posts_
    found = usual.repartition("token").sortWithinPartitions("token", "packed").mapInArrow(lambda b: _join_lists(b, least), "c1 bigint, c2 bigint, shared int")
    if hot:  # at most (all postings / HOT_LIST) tokens
        found = found.unionByName(_join_hot(posts_.join(F.broadcast(long), "token", "left_semi"), least))
    counted = found.groupBy("c1", "c2").agg(F.sum("shared").alias("shared"))
    out = stage(counted.where(F.col("shared") >= SHARED).select("c1", "c2"), "candidates")
    drop_staged(posts)
    return out


def similar_sets(first: DataFrame, codes, least: float) -> DataFrame:
    """(a, b, jaccard), a < b: every pair of classes in ``first`` (cid, class, tokens; one row per set) that reaches ``least``.

    ``codes`` is the broadcast ``frequency_codes`` of these sets, or of more.
    """
    posts = first.select("cid", "tokens").mapInArrow(lambda b: _postings(b, codes.value, least), "token int, cid bigint, packed bigint, often boolean")
    cand = _candidates(posts, least)
    involved = stage(cand.select(F.col("c1").alias("cid")).unionByName(cand.select(F.col("c2").alias("cid"))).distinct(), "involved")
    some = small_join(first, involved, ["cid"], "left_semi").select("cid", "class", "tokens")
    ordered = some.mapInArrow(lambda b: _order(b, codes.value), "meet bigint, cid bigint, class binary, size int, tokens array<int>")
    clusters = stage(ordered.repartition("meet").sortWithinPartitions("meet", "class").mapInArrow(_cluster, _CLUSTERS), "clusters")
    home = clusters.select("cluster", F.explode("cids").alias("cid"))
    linked = lookup_join(cand.withColumnRenamed("c1", "cid"), home.withColumnRenamed("cluster", "k1"), ["cid"]).drop("cid")
    linked = lookup_join(linked.withColumnRenamed("c2", "cid"), home.withColumnRenamed("cluster", "k2"), ["cid"])
    linked = linked.where("k1 <> k2").select(F.least("k1", "k2").alias("c1"), F.greatest("k1", "k2").alias("c2")).distinct()
    cols = ["leader", "classes", "sizes", "adds", "lacks"]
    one = clusters.select(F.col("cluster").alias("c1"), *[F.col(c).alias(c + "1") for c in cols])
    two = clusters.select(F.col("cluster").alias("c2"), *[F.col(c).alias(c + "2") for c in cols])
    both = lookup_join(lookup_join(linked, one, ["c1"]), two, ["c2"])
    schema = "a binary, b binary, jaccard double"
    between = both.mapInPandas(lambda b: _verify(b, least), schema)
    within = clusters.where(F.size("classes") > 1).select(*cols).mapInPandas(lambda b: _verify_within(b, least), schema)
    pairs = stage(between.unionByName(within), "pairs")
    for t in (clusters, cand):
        drop_staged(t)
    return pairs


def similar_classes(records: DataFrame, field: str, key: str, text: str, width: int = 5, least: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): pairs (a, b, jaccard) of classes of equal sets, a < b; members (field, key, copy, class) of classes with a pair or several rows.

    Shingles are ``width`` consecutive words (runs of a-z and 0-9 after lower-casing).
    Texts under ``width`` or ``least_words`` words, null texts and null keys take no part.
    Tokens are 32-bit hashes salted by field: two sets of 100 tokens have a false common
    one with a chance of two in a million.  Members of a class whose texts are exactly
    equal have one number ``copy``.
    """
    rows = records.select(F.col(field).alias("field"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("copy")).where("text is not null and key is not null")
    built = rows.mapInArrow(lambda b: _build(b, width, least_words), "field string, key string, copy bigint, class binary, tokens array<int>")
    # small numbers for sets: they are written out, so they stay the same
    sets = stage(built.withColumn("cid", F.monotonically_increasing_id()), "sets")
    codes = rows.sparkSession.sparkContext.broadcast(frequency_codes(sets))
    # of equal sets one is compared
    several = stage(sets.groupBy("class").agg(F.min("cid").alias("one"), F.count("*").alias("n")).where("n > 1").select("class", "one"), "several")
    extra = stage(small_join(sets.select("class", "cid"), several, ["class"]).where("cid <> one").select("cid"), "extra")
    first = sets.join(extra, "cid", "left_anti")
    pairs = similar_sets(first, codes, least)
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).unionByName(several.select("class")).distinct()
    members = stage(small_join(sets.select("field", "key", "copy", "class"), stage(wanted, "wanted"), ["class"], "left_semi").distinct(), "members")
    drop_staged(sets)
    return members, pairs


def copies(members: DataFrame) -> DataFrame:
    """(field, key, representative) of records with exactly one text, for ``members`` of ``similar_classes``: the smallest key stands for them."""
    first = stage(members.groupBy("class", "copy").agg(F.count("*").alias("n"), F.min("key").alias("representative")).where("n > 1").drop("n"), "copies")
    return small_join(members, first, ["class", "copy"]).select("field", "key", "representative")


def near_duplicates(records: DataFrame, field: str, key: str, text: str, width: int = 5, least: float = 0.8, least_words: int = 0, most_copies: int | None = MOST_COPIES) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: records of one field whose shingle sets have Jaccard >= ``least``.

    Records with exactly equal texts are copies.  Groups of up to ``most_copies`` have all
    their pairs listed; of larger ones each is paired with the smallest key, which alone
    stands for the group in pairs with other texts, those with an equal set among them.
    ``copies`` tells who is represented by whom, and ``most_copies`` None lists every pair
    of every group (salted, so that no task holds a group).  Null and short texts, see
    ``similar_classes``.
    """
    members, pairs = similar_classes(records, field, key, text, width, least, least_words)
    groups = stage(members.groupBy("class", "copy").agg(F.count("*").alias("n"), F.min("key").alias("first")), "groups")
    known = stage(small_join(members, groups, ["class", "copy"]), "grouped")
    every = F.lit(True) if most_copies is None else F.col("n") <= most_copies
    listed = stage(known.where(every | (F.col("key") == F.col("first"))).select("class", "field", "key"), "listed")
    sizes = listed.groupBy("class").agg(F.count("*").alias("size"))
    sizes = stage(sizes.where("size > 1").select("class", F.ceil(F.col("size") / MEMBERS_A_TASK).cast("int").alias("salts")), "class-sizes")
    across = _with_members(_with_members(pairs.select("a", "b"), listed, sizes, "a"), listed.drop("field"), sizes, "b").select("field", "ka", "kb")
    own = small_join(listed, sizes.select("class"), ["class"], "left_semi").select(F.col("class").alias("b"), F.col("key").alias("ka"))
    equal = _with_members(own, listed, sizes, "b").where("ka < kb").select("field", "ka", "kb")
    stars = known.where(~every & (F.col("key") != F.col("first"))).select("field", F.col("first").alias("ka"), F.col("key").alias("kb"))
    out = across.unionByName(equal).unionByName(stars)
    return out.select("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def _with_members(rows: DataFrame, listed: DataFrame, sizes: DataFrame, side: str) -> DataFrame:
    """``rows`` once for each member of the class in column ``side``; its key is k``side``.

    The members of a large class are salted and its rows repeated for each salt (``sizes``
    has the salts of classes with several members), so that no task holds a class.
    """
    many = sizes.where("salts > 1")
    right = listed.select(F.col("class").alias(side), F.col("key").alias("k" + side), *[c for c in listed.columns if c == "field"])
    if many.isEmpty():
        return rows.join(right, side)
    # at most (all members / MEMBERS_A_TASK) classes
    many = F.broadcast(many.withColumnRenamed("class", side))
    left = rows.join(many, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    right = right.join(many, side, "left").withColumn("salt", F.pmod(F.xxhash64("k" + side), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return left.join(right, [side, "salt"]).drop("salt")
