"""Subject areas of documents, by labels propagated over a verified document-similarity graph.

The graph has two kinds of edges.  Documents that share content terms are tied through
these, as document-term and term-document halves (edges between all such documents would
grow with the square of a subject); a term carries labels only if it is verified: its
documents must agree on one subject far beyond chance.  Documents that are nearly the same
text are tied directly, by verified similarity.  Labels first spread over terms, and each
sentence takes the subject of most of its mentions, which gives every document a share per
subject.  From these shares labels are propagated over the direct edges until none changes:
trusted seeds are clamped and keep their labels to the end, a seed that its own text
contradicts is none.  A document has every subject whose share reaches a quarter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import neardup
from citeloom.llm.frames import nonempty
from citeloom.llm.spans import mix
from citeloom.skew import lookup_join, small_join
from citeloom.staging import drop_staged, stage

#: Documents from which on a term of a rare subject can be verified.
SEEN = 20
#: Deviations by which a term's share of a subject must stay below what verifies it, for the term to leave the graph.
SURE = 3.0
#: Least smoothed share of one subject among a term's documents, weight of the prior, least lift over it.
PURITY, PRIOR_WEIGHT, LIFT = 0.40, 4.0, 2.0
#: The same for rare subjects, whose terms others mention in passing: a lower share far beyond the prior.
RARE_PURITY, RARE_LIFT = 0.20, 5.0
#: Terms beyond which sentences are joined to terms instead of sending terms to every task; the result is the same.
MOST_SENT = 300_000
#: Edges between documents: shingle width and least similarity.  Weight of a clamped neighbour, of another one.
WIDTH, ALIKE = 5, 0.8
CLAMPED, OTHERS = 4.0, 1.0
#: Bands of a signature, of four values each; at similarity 0.8 two texts share less than two of them four times in ten thousand.
BANDS = 20
#: Rounds of propagation at most; labels settle earlier, as each round averages.
MOST_ROUNDS = 10

_TERM = re.compile(r"[^\W\d_]+(?:[-‑][^\W\d_]+)*")
_END = re.compile(r"(?<=[.!?])[\"'”)\]]*\s+")
_PLAIN = re.compile(r"[^\s.!?]")


def body_of(text: str) -> str:
    """A text without its heading (a first line that ends in no full stop)."""
    text = text.strip()
    first, newline, rest = text.partition("\n")
    if newline and first.strip()[-1:] not in ".!?;:,\"'”)" and rest.lstrip()[:1].isupper():
        return rest
    return text


def sentences(text: str | None) -> list[str]:
    """The sentences of a text without its heading."""
    return [s for s in _END.split(body_of(text)) if _PLAIN.search(s)] if text and text.strip() else []


def clean_labels(labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", subject: str = "subject") -> DataFrame:
    """Distinct (doc_id, subject): trimmed, lower case, and one of the canonical names."""
    names = subjects.select(F.col(subject).alias("subject"), F.lower(F.trim(subject)).alias("_k")).distinct()
    given = labels.select(F.col(doc_id).alias("doc_id"), F.lower(F.trim(subject)).alias("_k")).where("doc_id is not null").distinct()
    return given.join(names, "_k").select("doc_id", "subject")


_SPACED = bytes(c if chr(c).islower() or c == 45 else 32 for c in range(128)) + b" " * 128


def terms_in(low: str) -> list[str]:
    """The terms of a lower-case text in order: runs of letters, and such runs joined by single hyphens."""
    if not low.isascii() or "--" in low:
        return _TERM.findall(low)
    out = low.encode().translate(_SPACED).decode().split()
    if "-" in low:
        out = [w.strip("-") if w[0] == "-" or w[-1] == "-" else w for w in out]
        return [w for w in out if w]
    return out


def coded(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list of each word, its number, the words by number)."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [x for w in words for x in w]
    codes, unique = pd.factorize(flat)
    return np.repeat(np.arange(len(counts)), counts), codes, unique


_LETTER = np.array([c > 127 or chr(c).isalpha() for c in range(256)])
_SPACE, _FULL, _CLOSE = (np.array([c < 128 and test(chr(c)) for c in range(256)]) for test in (str.isspace, ".!?".__contains__, "\"')]".__contains__))


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word, its number, the words by number): ``terms_in`` of lower-case bytes, of which those from 128 on stand in terms only."""
    letter = _LETTER[data]
    word = letter.copy()
    hyphens = np.flatnonzero(data[1:-1] == 45) + 1
    word[hyphens[letter[hyphens - 1] & letter[hyphens + 1]]] = True
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    offsets = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2]))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[word])).dictionary_encode()
    return edges[::2], words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)


def numbered_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``coded`` of the terms of texts, found in all of them at once."""
    parts = [t.encode() if t.isascii() else " ".join(terms_in(t.lower())).encode() for t in texts]
    places, codes, unique = words_in(np.frombuffer(b"\n".join(parts).lower(), dtype=np.uint8))
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    counts = np.diff(np.searchsorted(places, ends), prepend=0)
    return np.repeat(np.arange(len(parts)), counts), codes, unique


def sorted_sets(n: int, owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``n`` + 1 offsets, values): the distinct values of each of ``n`` lists, ascending; ``owner`` ascends."""
    values = values.copy()
    cuts = np.searchsorted(owner, np.arange(n + 1))
    # many short lists: far cheaper than to sort all of them as one
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return np.concatenate(([0], np.cumsum(new)))[cuts].astype(np.int32), values[new]


def shingles_of(owner: np.ndarray, codes: np.ndarray, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, hash) of every run of ``WIDTH`` words inside one list."""
    n = len(codes) - WIDTH + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(unique, categorize=False)[codes]
    grams = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WIDTH):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    inside = owner[:n] == owner[WIDTH - 1 :]
    return owner[:n][inside], mix(grams[inside])


def signatures(n: int, owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, ``BANDS`` numbers) of those of ``n`` lists that have a shingle (``shingles_of``); lists with Jaccard ``ALIKE`` share two of them all but surely.

    One-permutation minhash of shingles of ``WIDTH`` words in four times as many bins as there
    are bands; an empty bin takes the value of the next one.  Edges between documents don't
    depend on it: ``similar_documents`` joins whole sets.
    """
    if not len(grams):
        return np.empty(0, dtype=np.int64), np.empty((0, BANDS), dtype=np.int64)
    bins = 4 * BANDS
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(n * bins, top)
    np.minimum.at(low, owner * bins + (grams % np.uint64(bins)).astype(np.int64), grams)
    low = low.reshape(-1, bins)
    rows = np.flatnonzero((low != top).any(axis=1))
    low = low[rows]
    for _ in range(bins):
        empty = low == top
        if not empty.any():
            break
        low = np.where(empty, np.roll(low, -1, axis=1), low)
    with np.errstate(over="ignore"):
        bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(low), BANDS))
        for j in range(4):
            bands = mix(bands * np.uint64(0xBF58476D1CE4E5B9) + low[:, j::4])
    return rows, bands.view(np.int64)


def shingle_sets(n: int, owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """(``n`` + 1 offsets, tokens, {list: 128-bit number of its set}): the distinct shingles (``shingles_of``) of ``n`` lists as 32-bit tokens; empty sets have no number."""
    cuts, tokens = sorted_sets(n, owner, (grams >> np.uint64(32)).astype(np.uint32))
    some = np.flatnonzero(np.diff(cuts))
    ids = np.zeros((len(some), 2), dtype=np.uint64)
    if len(some):
        with np.errstate(over="ignore"):
            for k in range(2):
                ids[:, k] = mix(np.add.reduceat(mix(tokens.astype(np.uint64) + np.uint64((k + 1) << 40)), cuts[some]))
    return cuts, tokens, {i: x.tobytes() for i, x in zip(some.tolist(), ids)}


@nonempty
def _terms(batches, packed: bool = False):
    """Distinct terms and shingles of each document; its class is the number of its set of shingles (16 bytes), without any the hash of the text (8).

    ``packed`` gives the shingles as bytes, which Spark moves as a whole.
    """
    for b in batches:
        n = b.num_rows
        owner, codes, unique = numbered_words(b["text"].to_pylist())
        parts, tokens, numbers = shingle_sets(n, *shingles_of(owner, codes, unique))
        classes = [numbers.get(i) or h.tobytes() for i, h in enumerate(b["hash"].to_numpy())]
        cuts, held = sorted_sets(n, owner, codes)
        terms = pa.array(unique, type=pa.string()).take(pa.array(held))
        if packed:
            sets = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(4 * parts), pa.py_buffer(tokens)])
        else:
            sets = pa.ListArray.from_arrays(pa.array(parts), pa.array(tokens.view(np.int32)))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(classes, type=pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), terms), sets], names=["doc_id", "class", "terms", "tokens"])


class PackedCodes:
    """``neardup.frequency_codes`` that are sent to tasks compressed and arrive as an array."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes

    def __reduce__(self):
        return _unpacked, (zlib.compress(self.codes, 1),)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype=np.uint8)


def similar_documents(held: DataFrame) -> DataFrame:
    """(a, b, s): every pair of classes with Jaccard ``s`` >= ``ALIKE`` of their shingle sets, a < b.

    The exact join of ``neardup`` over one document of each class; exact but for collisions
    of 32-bit tokens.  Pairs grow with the square of a group of texts that are all alike
    and all differ; texts of one set are one class and have no pairs.
    """
    several = stage(held.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "several-texts")
    alone = small_join(held, several.select("class"), ["class"], "left_anti").select("class", "tokens")
    first = small_join(held, several, ["doc_id", "class"], "left_semi").select("class", "tokens").dropDuplicates(["class"])
    sets = alone.unionByName(first).where(F.length("class") > 8).withColumn("cid", F.xxhash64("class"))
    codes = held.sparkSession.sparkContext.broadcast(PackedCodes(neardup.frequency_codes(sets)))
    return neardup.similar_sets(sets, codes, ALIKE).withColumnRenamed("jaccard", "s")


def term_votes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, n, subject, share, ok, open): what the labelled documents of each term say.

    ``edges``: doc_id, term.  ``labels``: doc_id, subject, w with w adding up to 1 per document.
    ``ok`` marks verified terms: their documents agree on one subject far beyond its share of
    all labels.  ``open`` is false for terms of which that is as good as impossible: the share
    of every subject stays below what it takes by ``SURE`` deviations.
    """
    prior = labels.groupBy("subject").agg(F.sum("w").alias("p"))
    total = labels.agg(F.sum("w").alias("all_w"))
    prior = prior.crossJoin(total).select("subject", (F.col("p") / F.col("all_w")).alias("prior"))  # one row times a dozen
    held = stage(labels.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "w")).alias("held")), "labels-of")
    votes = (
        small_join(edges, held, ["doc_id"])
        .select("term", F.explode("held").alias("h"))
        .groupBy("term", F.col("h.subject").alias("subject"))
        .agg(F.sum("h.w").alias("c"))
    )
    total_of = votes.groupBy("term").agg(F.sum("c").alias("n"), F.collect_list(F.struct("subject", "c")).alias("v"))  # one entry per subject
    each = total_of.select("term", "n", F.explode("v").alias("x")).select("term", "n", "x.subject", "x.c").join(F.broadcast(prior), "subject")
    share = (F.col("c") + PRIOR_WEIGHT * F.col("prior")) / (F.col("n") + PRIOR_WEIGHT)
    lift = share / F.col("prior")
    ok = ((share >= PURITY) & (lift >= LIFT)) | ((share >= RARE_PURITY) & (lift >= RARE_LIFT) & (F.col("n") >= SEEN))
    takes = F.least(F.greatest(F.lit(PURITY), LIFT * F.col("prior")), F.greatest(F.lit(RARE_PURITY), RARE_LIFT * F.col("prior")))
    z = SURE * SURE
    bound = (F.col("c") + z / 2 + SURE * F.sqrt(F.greatest(F.col("c") * (1 - F.col("c") / F.col("n")), F.lit(0.0)) + z / 4)) / (F.col("n") + z)
    unseen = F.lit(z) / (F.col("n") + z) >= RARE_PURITY
    best = each.groupBy("term", "n").agg(F.max(F.struct(ok.alias("ok"), F.when(ok, lift).otherwise(share).alias("r"), "subject", share.alias("share"))).alias("b"), F.bool_or(ok | unseen | (bound >= takes)).alias("open"))
    return best.select("term", "n", "b.subject", "b.share", "b.ok", "open")


def document_labels(edges: DataFrame, terms: DataFrame, seeds: DataFrame, least: float = 0.2) -> DataFrame:
    """(doc_id, subject, w): the seeds' own labels, and for the rest the shares of their terms' subjects from ``least`` on."""
    hits = small_join(edges, terms, ["term"])
    score = hits.groupBy("doc_id", "subject").agg(F.sum("share").alias("s"))
    per = score.groupBy("doc_id").agg(F.sum("s").alias("all_s"), F.collect_list(F.struct("subject", "s")).alias("v"))
    soft = (
        per.select("doc_id", "all_s", F.explode("v").alias("v"))
        .select("doc_id", F.col("v.subject").alias("subject"), (F.col("v.s") / F.col("all_s")).alias("w"))
        .where(F.col("w") >= least)
    )
    return soft.join(seeds.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(seeds)


#: Where sentences end, with the full stop.
_STOP = re.compile(r"[.!?][\"'”)\]]*\s+")


def sentence_subjects(text: str, subject_of) -> tuple[dict, int]:
    """(subject: sentences whose main subject it is, number of sentences); ``subject_of`` looks a term up, None for others.

    Neighbouring terms of one subject are one mention.
    """
    found: dict = {}
    n = 0
    for s in _STOP.split(body_of(text).lower()):
        words = terms_in(s)
        n += bool(words) or _PLAIN.search(s) is not None
        named = set(map(subject_of, words))
        named.discard(None)
        if len(named) == 1:
            main = named.pop()
        elif named:
            out, last = [], None
            for w in words:
                x = subject_of(w)
                if x is not None and x != last:
                    out.append(x)
                last = x
            main = main_subject(out)
        else:
            continue
        found[main] = found.get(main, 0) + 1
    return found, n


def main_subject(mentions: list):
    """The subject with most mentions, the first mentioned of equal ones; None without mentions."""
    if not mentions:
        return None
    if len(mentions) == 1:
        return mentions[0]
    return Counter(mentions).most_common(1)[0][0]


def sentence_counts(texts: list[str], number_of: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, subject, sentences whose main subject it is, sentences of the text): ``sentence_subjects`` of ASCII texts, all at once.

    ``number_of`` has the subjects of terms as numbers.
    """
    if not texts:
        return (np.empty(0, dtype=np.int64),) * 4
    parts = [body_of(t).encode() + b"\0" for t in texts]
    data = np.frombuffer(b"".join(parts).lower(), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
    plain = ~(_SPACE | _FULL)[data]
    plain[ends - 1] = False
    # a full stop, closing marks and a blank end a sentence
    stops = np.flatnonzero(_FULL[data])
    after = stops + 1
    while (closing := _CLOSE[data[after]]).any():
        after = after + closing
    real = _SPACE[data[after]]
    stops, blanks = stops[real], after[real]
    for k in range(1, int((blanks - stops).max(initial=1))):
        plain[(stops + k)[stops + k < blanks]] = False
    starts = np.sort(np.concatenate((blanks, ends - [len(p) for p in parts])))
    text_of = np.searchsorted(ends, starts, side="right")
    total = np.bincount(text_of[np.logical_or.reduceat(plain, starts)], minlength=len(texts))
    # neighbouring terms of one subject in a sentence are one mention
    places, codes, unique = words_in(data)
    subject = np.array([number_of.get(w, -1) for w in unique], dtype=np.int64)[codes]
    new = np.ones(len(places) + 1, dtype=bool)
    new[1:-1] = subject[1:] != subject[:-1]
    new[np.searchsorted(places, starts)] = True
    at = np.flatnonzero(new[:-1] & (subject >= 0))
    kinds = int(subject.max(initial=0)) + 1
    named, first, mentions = np.unique((np.searchsorted(starts, places[at], side="right") - 1) * kinds + subject[at], return_index=True, return_counts=True)
    order = np.lexsort((first, -mentions, named // kinds))
    named = named[order]
    main = named[np.diff(named // kinds, prepend=-1) != 0]
    found, n = np.unique(text_of[main // kinds] * kinds + main % kinds, return_counts=True)
    return found // kinds, found % kinds, n, total[found // kinds]


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, least: float = 0.25, graph: bool = True) -> DataFrame:
    """(doc_id, subject) for every subject whose propagated share of a document is at least ``least``.

    Null and blank texts have no row, nor have texts without verified terms that are neither
    trusted seeds nor tied to labelled ones.  Labels may repeat, be null, differ in case or
    blanks, or name documents that don't exist.  Without any usable label the result is
    empty.  Rows that repeat a doc_id give repeated results once.  ``graph`` False leaves
    the edges between documents out.
    """
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    kind = dict(docs.dtypes)[doc_id]
    seeds = clean_labels(labels, subjects)
    each = seeds.groupBy("doc_id").agg(F.count("*").alias("k"))
    seeds = stage(seeds.join(each, "doc_id").select("doc_id", "subject", (F.lit(1.0) / F.col("k")).alias("w")), "seeds")
    held = stage(corpus.mapInArrow(lambda b: _terms(b, packed=True), f"doc_id {kind}, class binary, terms array<string>, tokens binary"), "terms")
    terms = verified_terms(held, seeds, rounds)
    if terms.count() <= MOST_SENT:
        evidence = _by_lookup(corpus, terms, kind)
    else:
        evidence = _by_join(corpus, terms, kind)
    evidence = stage(evidence.distinct(), "evidence")
    return propagate(held, evidence, seeds, least, graph)


def verified_terms(held: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(term, subject, share) after labels went from documents to terms and back, until no term changes or for ``rounds``."""
    every = held.select("doc_id", F.explode("terms").alias("term"))
    seeded = small_join(held, seeds.select("doc_id").distinct(), ["doc_id"], "left_semi").select("doc_id", F.explode("terms").alias("term"))
    votes = stage(term_votes(seeded, seeds), "votes")
    # terms that labelled documents show to be neutral leave the graph
    neutral = stage(votes.where(~F.col("open")).select("term"), "neutral")
    edges = stage(small_join(every, neutral, ["term"], "left_anti"), "edges")
    terms = stage(votes.where("ok").select("term", "subject", "share"), "verified")
    for _ in range(1, rounds):
        labels_now = stage(document_labels(edges, terms, seeds), "labels")
        nxt = stage(term_votes(edges, labels_now).where("ok").select("term", "subject", "share"), "verified")
        same = nxt.join(terms.select("term", "subject"), ["term", "subject"], "left_anti").isEmpty() and nxt.count() == terms.count()
        drop_staged(terms)
        drop_staged(labels_now)
        terms = nxt
        if same:
            break
    drop_staged(edges)
    return terms


def trusted_seeds(evidence: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """(doc_id, subject, share) of seeds that their texts don't contradict.

    A text contradicts its labels if it has evidence, but of some label less than half of
    what it takes, or of another subject twice that.  A label's share is at least ``least``,
    and where nothing is known of the text its part among the labels.
    """
    own = evidence.select("doc_id", "subject", "share")
    both = own.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi").join(seeds.select("doc_id", "subject", F.lit(True).alias("label")), ["doc_id", "subject"], "full_outer")
    wrong = (F.col("label") & (F.coalesce("share", F.lit(0.0)) < least / 2)) | (F.col("label").isNull() & (F.col("share") >= 2 * least))
    some = both.groupBy("doc_id").agg(F.bool_or(wrong).alias("wrong"), F.max("share").alias("most"))
    good = some.where("not wrong or most is null").select("doc_id")
    return seeds.select("doc_id", "subject", "w").join(good, "doc_id").join(own, ["doc_id", "subject"], "left").select("doc_id", "subject", F.greatest(F.coalesce("share", "w"), F.lit(least)).alias("share"))


def propagate(held: DataFrame, evidence: DataFrame, seeds: DataFrame, least: float, graph: bool = True) -> DataFrame:
    """(doc_id, subject): labels after propagation over edges between similar documents.

    Texts with equal sets of shingles (128 bits of a hash), or equal texts without any, meet in
    their class and classes are tied by their verified similarity, so that a text with many copies
    has no edges between them all.  In a round a document's
    share of a subject becomes the mean of its own evidence and of its class and the
    neighbouring ones, in which clamped seeds weigh ``CLAMPED``.
    """
    docs = held.select("doc_id", "class")
    clamped = stage(trusted_seeds(evidence, small_join(seeds, docs.select("doc_id").distinct(), ["doc_id"], "left_semi"), least), "clamped")
    fixed = clamped.select("doc_id").distinct().withColumn("fixed", F.lit(True))
    every = evidence.join(fixed, "doc_id", "left").where("fixed is null").drop("fixed").unionByName(clamped)
    label = F.col("share") >= least - 1e-9
    if not graph:
        return every.where(label).select("doc_id", "subject")
    pairs = similar_documents(held)
    ties = pairs.select(F.col("a").alias("class"), F.col("b").alias("near"), "s").unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("near"), "s"))
    several = docs.distinct().groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class").unionByName(ties.select("class")).distinct()
    members = small_join(docs.distinct(), stage(several, "several"), ["class"], "left_semi")
    members = stage(members.join(fixed, "doc_id", "left").select("doc_id", "class", F.coalesce("fixed", F.lit(False)).alias("fixed"), F.when(F.col("fixed"), CLAMPED).otherwise(OTHERS).alias("weight")), "members")
    ties = stage(ties.unionByName(members.select("class").distinct().select("class", F.col("class").alias("near"), F.lit(1.0).alias("s"))), "ties")
    mass = members.groupBy(F.col("class").alias("near")).agg(F.sum("weight").alias("m"))
    mass = stage(ties.join(mass, "near").groupBy("class").agg(F.sum(F.col("s") * F.col("m")).alias("mass")), "masses")
    own = small_join(every.where(F.col("share") > 0), members.select("doc_id", "class", "fixed", "weight"), ["doc_id"])
    own = stage(own.select("doc_id", "class", "fixed", "weight", "subject", "share"), "own")
    now = own
    for _ in range(MOST_ROUNDS):
        sums = now.groupBy("class", "subject").agg(F.sum(F.col("weight") * F.col("share")).alias("x"))
        near = ties.join(sums.select(F.col("class").alias("near"), "subject", "x"), "near").groupBy("class", "subject").agg(F.sum(F.col("s") * F.col("x")).alias("x"))
        told = near.join(mass, "class").groupBy("class").agg(F.first("mass").alias("mass"), F.collect_list(F.struct("subject", "x")).alias("told"))  # one entry per subject
        each = lookup_join(members.where("not fixed"), told, ["class"]).select("doc_id", "class", "fixed", "weight", "mass", F.explode("told").alias("t")).select("doc_id", "class", "fixed", "weight", "mass", "t.subject", "t.x")
        moved = each.join(own.select("doc_id", "subject", F.col("share").alias("own")), ["doc_id", "subject"], "left").join(now.select("doc_id", "subject", F.col("share").alias("before")), ["doc_id", "subject"], "left")
        share = (F.coalesce("own", F.lit(0.0)) + F.col("x")) / (1 + F.col("mass"))
        turned = (share >= least - 1e-9) != (F.coalesce("before", F.lit(0.0)) >= least - 1e-9)
        moved = moved.select("doc_id", "class", "fixed", "weight", "subject", share.alias("share"), turned.alias("turned"))
        nxt = stage(moved.unionByName(own.where("fixed").withColumn("turned", F.lit(False))), "shares")
        settled = nxt.where("turned").isEmpty()
        now = nxt.drop("turned")
        if settled:
            break
    rest = small_join(every, members.select("doc_id"), ["doc_id"], "left_anti")
    return rest.where(label).select("doc_id", "subject").unionByName(now.where(label).select("doc_id", "subject"))


def _by_lookup(corpus: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """(doc_id, subject, share): the share of a document's sentences that each subject takes."""
    rows = terms.select("term", "subject").collect()
    names = sorted({r.subject for r in rows})
    shared = corpus.sparkSession.sparkContext.broadcast({r.term: names.index(r.subject) for r in rows})

    @nonempty
    def decide(batches):
        number_of = shared.value
        for b in batches:
            texts = b["text"].to_pylist()
            ascii = np.array([t.isascii() for t in texts], dtype=bool)
            text, subject, x, n = sentence_counts([t for t, a in zip(texts, ascii) if a], number_of)
            at, out, shares = [np.flatnonzero(ascii)[text]], [subject], [x / n]
            for k in np.flatnonzero(~ascii):
                found, n = sentence_subjects(texts[k], number_of.get)
                at.append(np.full(len(found), k))
                out.append(np.fromiter(found, dtype=np.int64))
                shares.append(np.array([x / n for x in found.values()]))
            at, out, shares = (np.concatenate(c) for c in (at, out, shares))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at)), pa.array(names, type=pa.string()).take(pa.array(out)), pa.array(shares, type=pa.float64())], names=["doc_id", "subject", "share"])

    return corpus.select("doc_id", "text").mapInArrow(decide, f"doc_id {kind}, subject string, share double")


def _by_join(corpus: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """The same as ``_by_lookup`` with sentences joined to terms."""

    @nonempty
    def split(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                parts = sentences(t)
                for k, s in enumerate(parts):
                    rows += [(i, len(parts), k, p, w) for p, w in enumerate(_TERM.findall(s.lower()))]
            yield pd.DataFrame(rows, columns=["doc_id", "parts", "k", "p", "term"])

    words = corpus.mapInPandas(split, f"doc_id {kind}, parts int, k int, p int, term string").distinct()
    hits = lookup_join(words, terms.select("term", "subject"), ["term"])
    per = hits.groupBy("doc_id", "parts", "k").agg(F.array_sort(F.collect_list(F.struct("p", "subject"))).alias("h"))
    starts = F.filter("h", lambda x, i: ~F.exists("h", lambda y: (y["p"] == x["p"] - 1) & (y["subject"] == x["subject"])))
    mentions = per.select("doc_id", "parts", "k", F.explode(starts).alias("m"))
    counts = mentions.groupBy("doc_id", "parts", "k", F.col("m.subject").alias("subject")).agg(F.count("*").alias("n"), F.min("m.p").alias("first"))
    main = counts.groupBy("doc_id", "parts", "k").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "subject")).alias("b"))
    shares = main.groupBy("doc_id", "parts", F.col("b.subject").alias("subject")).agg(F.count("*").alias("n"))
    return shares.select("doc_id", "subject", (F.col("n") / F.col("parts")).alias("share"))
