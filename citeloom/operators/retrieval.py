"""Search: BM25, TF-IDF cosine, dense vectors, rank fusion and coverage."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.staging import stage

#: Weights of the searched fields, and BM25's two constants.
FIELD_WEIGHTS = {"tag": 8.0, "read_text": 4.0, "cite_raw": 2.0, "body": 1.0}
K1, B = 1.2, 0.75
#: Constant of reciprocal rank fusion.
RRF = 60
#: Cosines that a hit of each mode must exceed.
FLOORS = {"strict": 0.15, "balanced": 0.03, "explore": 0.0}
# English words that TF-IDF leaves out.
STOP_WORDS = tuple("a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its may more most no not of on or other our out over she so some such than that the their them then there these they this to was we were what when where which while who will with would you your".split())
# Request framing and fillers of conversational queries, and small synonym lists.
REQUEST = r"^(?:please\s+)?(?:find|show|search(?:\s+for)?|give me|i need|locate)\s+"
FILLER = r"\b(?:cards?|evidence|arguments?|that|which|saying|about|on|related to|according to|for my case|in debate)\b"
SYNONYMS = {
    "ban": ("ban", "prohibition", "moratorium"), "bans": ("ban", "prohibition", "moratorium"), "cost": ("cost", "rate", "burden"), "costs": ("cost", "rates", "burden"),
    "emissions": ("emissions", "pollution", "carbon"), "household": ("household", "ratepayer", "residential"), "households": ("households", "ratepayers", "residential"),
    "nuclear": ("nuclear", "reactor", "atomic"), "renewable": ("renewable", "clean energy", "wind solar"),
}


def words_of(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def query_tree(query: str) -> list[list[tuple[str, str]]]:
    """A query as alternatives of (sign, term or phrase): AND within, OR between, NOT as minus.

    Quoted phrases stay whole; anything else is a plain term, so no syntax can break it.
    """
    out: list[list[tuple[str, str]]] = [[]]
    sign = "+"
    for phrase, word in re.findall(r'"([^"]+)"|(\S+)', query):
        if word.upper() == "OR":
            out.append([])
        elif word.upper() == "NOT":
            sign = "-"
        elif word.upper() != "AND":
            terms = re.findall(r"\w+", (phrase or word).lower())
            if terms:
                out[-1].append((sign, " ".join(terms)))
            sign = "+"
    return [a for a in out if any(s == "+" for s, _ in a)]


def bm25(docs: DataFrame, key: str, query: str, k: int = 25, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """(key, score): the ``k`` best documents for a query, by BM25 with weighted fields; see ``bm25_many``."""
    return bm25_many(docs, key, [query], k, weights).select(key, "score").orderBy(F.desc("score"), key)


def bm25_many(docs: DataFrame, key: str, queries: list[str], k: int = 25, weights: dict[str, float] = FIELD_WEIGHTS, allowed: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank): the ``k`` best documents for each of a few queries (by their place in the list).

    Term frequency is the weighted sum over fields, length the number of words of all
    fields.  Texts are read once, for the terms of all queries; what is kept of a document
    is a number per term.  Sizes and frequencies are those of the whole corpus, ``allowed``
    (key) masks what may be found.
    """
    trees = [query_tree(q) for q in queries]
    terms = list(dict.fromkeys(t for tree in trees for alt in tree for _, t in alt))
    if not terms or k <= 0:
        return docs.select(F.lit(0).alias("query"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    fields = [f for f in weights if f in docs.columns]
    split = docs.select(key, *[F.concat(F.lit(" "), F.array_join(words_of(F.col(f)), " "), F.lit(" ")).alias(f) for f in fields])
    length = sum((F.length(F.col(f)) - F.length(F.replace(F.col(f), F.lit(" "), F.lit(""))) - 1 for f in fields), F.lit(0))

    def hits(t):
        # neighbouring repeats share a blank, so blanks are doubled before counting
        parts = [F.lit(weights[f]) * F.regexp_count(F.replace(F.col(f), F.lit(" "), F.lit("  ")), F.lit(" " + t.replace(" ", "  ") + " ")) for f in fields]
        return sum(parts, F.lit(0.0))

    scored = stage(split.select(key, length.alias("len"), *[hits(t).alias(f"tf{i}") for i, t in enumerate(terms)]), "term-hits")
    stats = scored.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    at = {t: i for i, t in enumerate(terms)}
    norm = F.lit(K1) * (1 - F.lit(B) + F.lit(B) * F.col("len") / F.col("avg_len"))

    def part(i):
        rare = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        return rare * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm)

    found = []
    for q, tree in enumerate(trees):
        if tree:
            match = reduce(lambda x, y: x | y, (reduce(lambda x, y: x & y, (F.col(f"tf{at[t]}") > 0 if s == "+" else F.col(f"tf{at[t]}") == 0 for s, t in alt)) for alt in tree))
            score = sum((part(i) for i in sorted({at[t] for alt in tree for s, t in alt if s == "+"})), F.lit(0.0))
            found.append(F.when(match, F.struct(F.lit(q).alias("query"), score.alias("score"))))
    any_term = reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    rows = scored.where(any_term) if allowed is None else scored.where(any_term).join(allowed.select(key).distinct(), key, "left_semi")
    rows = rows.crossJoin(F.broadcast(stats)).select(key, F.explode(F.array_compact(F.array(*found))).alias("f"))  # stats: one row
    return top_per(rows.select("f.query", key, "f.score"), "query", key, k).select("query", key, "score", "rank")


def tfidf_vectors(docs: DataFrame, key: str, text: str, max_df: float = 0.85, max_features: int = 120_000) -> DataFrame:
    """(key, term, w, idf): L2-normalised vectors of words and word pairs with sublinear counts.

    Terms in more than ``max_df`` of the documents are left out, and of the others the
    ``max_features`` most frequent are kept (ties by term).  Where that leaves nothing,
    as in tiny corpora, all terms are kept.
    """
    counts = stage(term_counts(docs, key, text), "term-counts")  # read three times below
    n = docs.select(key).distinct().agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("total")).crossJoin(F.broadcast(n))
    kept = df.where(F.col("df") <= max_df * F.col("n"))
    if kept.isEmpty():
        kept = df
    vocab = kept.orderBy(F.desc("total"), "term").limit(max_features).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(vocab, "term").select(key, "term", ((1 + F.log("c")) * F.col("idf")).alias("w"), "idf")
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"), "idf")


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, c): the words and word pairs of each text but the stop words."""
    toks = F.filter(words_of(F.col(text)), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    rows = docs.select(key, toks.alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, F.explode(F.concat("t", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))


def query_vectors(vectors: DataFrame, queries: list[str]) -> tuple[DataFrame, DataFrame]:
    """(query, term, w) of a few requests by the terms of a fitted corpus, and the rows of ``vectors`` that have one of these terms."""
    rows = vectors.sparkSession.createDataFrame([(i, q) for i, q in enumerate(queries)], "query int, text string")
    counts = term_counts(rows, "query", "text").collect()  # the words of a few requests
    met = vectors.where(F.col("term").isin([r.term for r in counts])) if counts else vectors.limit(0)
    met = stage(met, "met-terms")
    idf = {r.term: r.idf for r in met.groupBy("term").agg(F.first("idf").alias("idf")).collect()}
    own = [(r["query"], r["term"], (1 + math.log(r["c"])) * idf[r["term"]]) for r in counts if r["term"] in idf]
    norm: dict = {}
    for q, _, w in own:
        norm[q] = norm.get(q, 0.0) + w * w
    return vectors.sparkSession.createDataFrame([(q, t, w / math.sqrt(norm[q])) for q, t, w in own], "query int, term string, w double"), met


#: Queries with one term that one task joins.
QUERIES_A_TASK = 200


def sparse_cosine(vectors: DataFrame, queries: DataFrame, key: str, query_key: str) -> DataFrame:
    """(query_key, key, score) of all pairs that share a term; both sides L2-normalised (key, term, w)."""
    q = queries.select(F.col(query_key), "term", F.col("w").alias("qw"))
    # the rows of a term are spread by its queries, so that no task joins all of a frequent one
    hot = q.groupBy("term").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("salts")).where("salts > 1")
    q = q.join(hot, "term", "left").withColumn("_s", F.pmod(F.xxhash64(query_key), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    v = vectors.select(key, "term", "w").join(hot, "term", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return v.join(q, ["term", "_s"]).groupBy(query_key, key).agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """An array column as a vector of length 1; null where all is zero."""
    n = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Of two array columns; null where either is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def dense_topk(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str = "embedding", k: int = 10, floor: float = 0.0) -> DataFrame:
    """(query_key, key, score, rank): the ``k`` nearest vectors of each query above ``floor``, without the query itself.

    ``queries`` is a stated, small set; it meets the vectors block by block.
    """
    q = queries.select(F.col(query_key), unit(F.col(vector)).alias("_query"))
    pairs = vectors.select(F.col(key), unit(F.col(vector)).alias("v")).crossJoin(q).where(F.col(key) != F.col(query_key))
    scored = pairs.select(query_key, key, dot(F.col("v"), F.col("_query")).alias("score")).where(F.col("score") > floor)
    return top_per(scored, query_key, key, k)


def top_per(scored: DataFrame, query_key: str, key: str, k: int, salts: int = 64) -> DataFrame:
    """The ``k`` best rows per query with their rank; cut per salt first, so no task ranks all rows of a query."""
    order = [F.desc("score"), F.col(key)]
    salted = scored.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(salts)))
    cut = salted.withColumn("_r", F.row_number().over(W.partitionBy(query_key, "_s").orderBy(*order))).where(F.col("_r") <= k).drop("_r", "_s")
    return cut.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(*order))).where(F.col("rank") <= k)


def fuse_ranks(lexical: DataFrame, vector: DataFrame, key: str, k: int = 25) -> DataFrame:
    """(key, lexical_rank, vector_rank, score): reciprocal rank fusion of two rankings (key, rank)."""
    both = lexical.select(key, F.col("rank").alias("lexical_rank")).join(vector.select(key, F.col("rank").alias("vector_rank")), key, "full_outer")
    part = [F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0)) for c in ("lexical_rank", "vector_rank")]
    return both.withColumn("score", part[0] + part[1]).orderBy(F.desc("score"), key).limit(k)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """``hits`` (already cut to a pool) with a rank by score."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def corpus_vectors(cards: DataFrame) -> DataFrame:
    """TF-IDF vectors of cards, for searches: fit them once (or take ``index.current``) and hand them over."""
    from citeloom.functions.text import vector_text

    return tfidf_vectors(cards.select("card_id", vector_text(F.col("tag"), F.col("read_text"), F.col("body")).alias("text")), "card_id", "text")


def hybrid_search(cards: DataFrame, query: str, k: int = 25, mode: str = "balanced", allowed: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(card_id, lexical_rank, vector_rank, score): BM25 and TF-IDF cosine, fused.

    Both are fitted on all cards; ``allowed`` (card_id) masks what may be found before
    anything is ranked, and changes no score.  A blank query or ``k`` of 0 gives no rows.
    """
    return hybrid_many(cards, [query], k, mode, allowed, vectors).drop("query").orderBy(F.desc("score"), "card_id")


def hybrid_many(cards: DataFrame, queries: list[str], k: int = 25, mode: str = "balanced", allowed: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query, card_id, lexical_rank, vector_rank, score): ``hybrid_search`` for a few queries in one plan."""
    if k <= 0 or not any(q.strip() for q in queries):
        return cards.select(F.lit(0).alias("query"), "card_id", F.lit(0).alias("lexical_rank"), F.lit(0).alias("vector_rank"), F.lit(0.0).alias("score")).limit(0)
    pool = max(4 * k, 60)
    if allowed is not None:
        allowed = stage(allowed.select("card_id").distinct(), "allowed")
    lexical = bm25_many(cards, "card_id", queries, pool, FIELD_WEIGHTS, allowed)
    asked, met = query_vectors(corpus_vectors(cards) if vectors is None else vectors, queries)
    if allowed is not None:
        met = met.join(allowed, "card_id", "left_semi")
    near = met.join(F.broadcast(asked.withColumnRenamed("w", "qw")), "term").groupBy("query", "card_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))  # the terms of a few requests
    vector = top_per(near.where(F.col("score") > FLOORS[mode]), "query", "card_id", pool)
    both = lexical.select("query", "card_id", F.col("rank").alias("lexical_rank")).join(vector.select("query", "card_id", F.col("rank").alias("vector_rank")), ["query", "card_id"], "full_outer")
    part = [F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0)) for c in ("lexical_rank", "vector_rank")]
    return top_per(both.withColumn("score", part[0] + part[1]), "query", "card_id", k).drop("rank")


def coverage(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, floor: float = 0.35, within: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(query_key, key, score): whether there is evidence at all: cosine at least ``floor``.

    ``within`` (key) restricts the evidence, an empty one leaves none; ``without`` (query_key,
    key) names evidence that never counts for a query.
    """
    rows = vectors if within is None else vectors.join(within.select(key).distinct(), key, "left_semi")
    scored = sparse_cosine(rows, queries, key, query_key).where(F.col("score") >= floor)
    return scored if without is None else scored.join(without.select(query_key, key).distinct(), [query_key, key], "left_anti")


# What a request may state, as (filters that its two groups give, pattern).  Single years count only where no range is stated.
STATED = (
    ("side", r"\b(?:on\s+the\s+)?(affirmative|aff|negative|neg)\s+(?:side|cards?|case)\b()"),
    ("range", r"\b(?:between\s+)?((?:19|20|21)\d{2})\s+(?:and|to|through|-)\s+((?:19|20|21)\d{2})\b"),
    ("from", r"\b(?:from|after|since)\s+((?:19|20|21)\d{2})\b()"),
    ("until", r"\b(?:before|until|through|up\s+to)\s+((?:19|20|21)\d{2})\b()"),
    ("in", r"\bin\s+((?:19|20|21)\d{2})\b()"),
)


def parsed_requests(requests: DataFrame, text: str = "text") -> DataFrame:
    """``requests`` with plain, side, year_min and year_max: what a conversational request asks for, and the conditions it states.

    A fold over the table of patterns, so that a table of requests is parsed where it lies:
    what a pattern finds first leaves the text and becomes a filter.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    none = F.lit(None).cast("int")
    state = F.struct(raw.alias("t"), F.lit(None).cast("string").alias("side"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("ranged"))
    table = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit("(?i)" + p).alias("p")) for kind, p in STATED])

    def take(s, x):
        kind = x["kind"]
        hit = F.regexp_substr(s["t"], x["p"])
        use = hit.isNotNull() & (kind.isin("side", "range") | ~s["ranged"])
        first, second = (F.call_function("regexp_extract", s["t"], x["p"], F.lit(i)) for i in (1, 2))
        a, b = first.try_cast("int"), second.try_cast("int")
        at = F.position(hit, s["t"])
        return F.struct(
            F.when(use, F.concat(F.substr(s["t"], F.lit(1), at - 1), F.lit(" "), F.substr(s["t"], at + F.length(hit)))).otherwise(s["t"]).alias("t"),
            F.when(use & (kind == "side"), F.lower(F.substr(first, F.lit(1), F.lit(3)))).otherwise(s["side"]).alias("side"),
            F.when(use & kind.isin("range", "from", "in"), F.least(a, b)).otherwise(s["lo"]).alias("lo"),
            F.when(use & kind.isin("range", "until", "in"), F.greatest(a, b)).otherwise(s["hi"]).alias("hi"),
            (s["ranged"] | (use & (kind == "range"))).alias("ranged"),
        )

    rows = requests.withColumn("_s", F.aggregate(table, state, take))
    return rows.withColumns({"plain": plain_request(F.col("_s.t")), "side": F.col("_s.side"), "year_min": F.col("_s.lo"), "year_max": F.col("_s.hi")}).drop("_s")


def plain_request(c: Column) -> Column:
    """A request without its framing and fillers."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "(?i)" + REQUEST, ""), "(?i)" + FILLER, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"^[ .,?!;:]+|[ .,?!;:]+$", "")


def smart_request(spark, query: str) -> tuple[str, dict]:
    """The plain form of one request and the filters it states."""
    r = parsed_requests(spark.createDataFrame([(query,)], "text string")).first()
    return r["plain"], {n: r[n] for n in ("side", "year_min", "year_max") if r[n] is not None}


def variants(requests: DataFrame, text: str = "text", most: int = 5) -> DataFrame:
    """(the columns of ``requests``, variant, form): a request as it is, its plain form, and that with one word replaced by another of its list; each form once, whatever its case."""
    table = F.create_map(*[x for word, others in SYNONYMS.items() for x in (F.lit(word), F.lit(next(o for o in others if o != word)))])
    raw = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    rows = requests.withColumn("_raw", raw).withColumn("_plain", plain_request(F.col("_raw"))).withColumn("_words", F.split("_plain", " "))
    swapped = F.transform(
        F.filter(F.sequence(F.lit(1), F.size("_words")), lambda i: F.element_at(table, _bare_word(F.element_at("_words", i))).isNotNull()),
        lambda i: F.array_join(F.transform("_words", lambda w, k: F.when(k + 1 == i, F.replace(F.lower(w), _bare_word(w), F.element_at(table, _bare_word(w)))).otherwise(w)), " "),
    )
    forms = F.filter(F.concat(F.array("_raw", "_plain"), swapped), lambda f: f != "")
    first = F.filter(forms, lambda f, i: ~F.exists(F.slice(forms, F.lit(1), i), lambda g: F.lower(g) == F.lower(f)))
    return rows.select(*requests.columns, F.posexplode(F.slice(first, 1, most)).alias("variant", "form"))


def _bare_word(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"^[^\w'-]+|[^\w'-]+$", "")


def query_variants(spark, query: str, most: int = 5) -> list[str]:
    """The forms under which one request is searched."""
    return [r["form"] for r in variants(spark.createDataFrame([(query,)], "text string"), most=most).orderBy("variant").collect()]


def fuse_variants(hits: DataFrame, key: str, k: int = 25) -> DataFrame:
    """(key, score, confidence, variants): hits of several variants (variant, key, score, confidence, strength).

    Scores add up with weight 1 / (1 + 0.35 variant); the strongest confidence is kept, of equal ones the earliest.
    """
    best = F.max_by("confidence", F.struct("strength", (-F.col("variant")).alias("v"))).alias("confidence")
    out = hits.groupBy(key).agg(F.sum(F.col("score") / (1 + 0.35 * F.col("variant"))).alias("score"), best, F.array_sort(F.collect_set("variant")).alias("variants"))
    return out.orderBy(F.desc("score"), key).limit(k)


def smart_search(cards: DataFrame, query: str, k: int = 25, vectors: DataFrame | None = None, **filters) -> DataFrame:
    """(card_id, score, confidence, variants): all variants of a request searched in one plan under its filters, and fused."""
    from citeloom.functions.text import match_quality, matched_terms

    plain, stated = smart_request(cards.sparkSession, query)
    stated |= {n: v for n, v in filters.items() if v is not None}
    allowed = metadata_filter(cards, None, **stated).select("card_id") if stated else None
    forms = query_variants(cards.sparkSession, plain)
    if not forms:
        return cards.select("card_id", F.lit(0.0).alias("score"), F.lit("").alias("confidence"), F.array().cast("array<int>").alias("variants")).limit(0)
    found = stage(hybrid_many(cards, forms, max(2 * k, 25), allowed=allowed, vectors=vectors), "variant-hits")
    hits = found.join(cards.select("card_id", "tag", "read_text", "cite_raw"), "card_id")
    confidence = F.lit(None).cast("string")
    for i, text in enumerate(forms):
        q = match_quality(matched_terms(text, F.col("tag"), F.col("read_text"), F.col("cite_raw")), F.col("lexical_rank"), F.col("vector_rank"))
        confidence = F.when(F.col("query") == i, q["confidence"]).otherwise(confidence)
    hits = hits.select(F.col("query").alias("variant"), "card_id", "score", confidence.alias("confidence"))
    hits = hits.withColumn("strength", F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0))
    return fuse_variants(hits, "card_id", k)


def similar_cards(cards: DataFrame, card_id: str, k: int = 10) -> DataFrame:
    """Cards found by a card's read text, else its body, else its tag; without the card itself."""
    row = cards.where(F.col("card_id") == card_id).select("read_text", "body", "tag").first()
    text = next((t for t in (row or ()) if t and t.strip()), "")
    words = " OR ".join(dict.fromkeys(re.findall(r"\w{4,}", text.lower())))
    hits = hybrid_search(cards, words, k + 1).where(F.col("card_id") != card_id)
    return hits.orderBy(F.desc("score"), "card_id").limit(k)


def metadata_filter(cards: DataFrame, sources: DataFrame | None, side=None, author=None, year_min=None, year_max=None, block=None, min_read_ratio=None, source=None) -> DataFrame:
    """Cards that meet every stated condition; ``side`` both is none.  Conditions reach the scan."""
    rows = cards
    if side and side != "both":
        rows = rows.where(F.col("side") == side)
    if author:
        rows = rows.where(F.lower("cite_author") == author.lower())
    if year_min is not None:
        rows = rows.where(F.coalesce("cite_year", F.lit(0)) >= year_min)
    if year_max is not None:
        rows = rows.where(F.coalesce("cite_year", F.lit(9999)) <= year_max)
    if block:
        rows = rows.where(F.lower("block").contains(block.lower()))
    if min_read_ratio is not None:
        rows = rows.where(F.coalesce(F.nanvl("read_ratio", F.lit(0.0)), F.lit(0.0)) >= min_read_ratio)
    if source:
        where = F.lower(F.concat_ws(" ", *[F.col(f"s.{c}") for c in ("title", "origin", "path")]))
        hay = F.lower(F.concat_ws(" ", F.col("c.source_id"), where))
        rows = rows.alias("c").join(sources.alias("s"), F.col("c.source_id") == F.col("s.source_id"), "left").where(hay.contains(source.lower())).select("c.*")
    return rows

