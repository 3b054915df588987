"""Queries that search."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import index
from citeloom.operators import retrieval as R
from citeloom.operators.neighbours import tfidf_neighbours
from citeloom.plans.evidence import _CARDS, NOW, SLOW
from citeloom.plans.registry import cards, query
from citeloom.staging import shared_dir, stage

QUERY = "carbon sinks OR interest rates"
_TERMS = {"carbon": 0, "sinks": 1, "interest": 2, "rates": 3}


def _field(f: str) -> str:
    return rf"' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> ''), ' ') || ' '"


def _tf(t: str) -> str:
    return " + ".join(f"{w} * len(regexp_extract_all(replace({f}, ' ', '  '), ' {t} '))" for f, w in R.FIELD_WEIGHTS.items())


def bm25_sql(match: str, limit: int) -> str:
    """BM25 over the fields of cards for the terms of ``QUERY``."""
    fields = ", ".join(f"{_field(f)} AS {f}" for f in R.FIELD_WEIGHTS)
    length = " + ".join(f"len(string_split({f}, ' ')) - 2" for f in R.FIELD_WEIGHTS)
    tfs = ", ".join(f"{_tf(t)} AS tf{i}" for t, i in _TERMS.items())
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in _TERMS.values())
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0.000001) * tf{i} * {R.K1 + 1} / (tf{i} + {R.K1} * (1 - {R.B} + {R.B} * len / avg_len))" for i in _TERMS.values())
    return f"""WITH s AS (SELECT card_id, {fields} FROM {_CARDS}), l AS (SELECT card_id, {length} AS len, {tfs} FROM s), t AS (SELECT count(*) AS n, avg(len) AS avg_len, {dfs} FROM l),
    h AS (SELECT card_id, {score} AS score FROM l, t WHERE {match}) SELECT card_id, round(score, 6) AS score FROM h ORDER BY round(score, 9) DESC, card_id LIMIT {limit}"""


_COLS = ("tag", "read_text", "cite_raw", "body")


def corpus(spark, d, *columns):
    """The cards without re-deliveries, written out once: a search reads them several times."""
    return stage(cards(spark, d, *_COLS, *columns), "corpus")


def fitted(spark, d, own):
    """The stored vectors of the corpus: fitted by the first search, and taken by the others while the corpus is the same."""
    return index.current(own, f"{shared_dir(spark).rstrip('/')}/index-{zlib.crc32(str(d).encode()):08x}")


@query(bm25_sql("(tf0 > 0 AND tf1 > 0) OR (tf2 > 0 AND tf3 > 0)", 25))
def bm25_topk(spark, d):
    """The 25 best cards for a query, by BM25 with weighted fields (top-k is the feature)."""
    return R.bm25(corpus(spark, d), "card_id", QUERY, 25).select("card_id", F.round("score", 6).alias("score"))


@query()
def flagship_hits(spark, d):
    """Hybrid hits with match labels, source, traceability and freshness."""
    own = corpus(spark, d, "source_id", "disclosed_only")
    hits = R.hybrid_search(own, QUERY, 25, vectors=fitted(spark, d, own))
    s = spark.read.parquet(f"{d}/sources.parquet").select("source_id", F.col("title").alias("source_title"), "origin", "fetched_at", "last_refresh_failed_at")
    rows = hits.join(own, "card_id").join(s, "source_id", "left")
    terms = T.matched_terms(QUERY, F.col("tag"), F.col("read_text"), F.col("cite_raw"))
    rows = rows.withColumn("terms", terms).withColumn("q", T.match_quality(F.col("terms"), F.col("lexical_rank"), F.col("vector_rank")))
    now = F.lit(NOW).cast("timestamp")
    return rows.select(
        "card_id", "tag", "source_title", F.round("score", 6).alias("score"), "lexical_rank", "vector_rank", "q.confidence", "q.match_type", F.array_join(T.match_reasons(F.col("terms"), F.col("lexical_rank"), F.col("vector_rank")), "; ").alias("reasons"),
        T.evidence_status(F.col("cite_raw"), F.col("source_id"), F.col("read_text"), F.col("disclosed_only")).alias("status"),
        T.source_freshness(F.col("fetched_at"), F.col("last_refresh_failed_at"), F.coalesce(F.col("origin").isin(*SLOW), F.lit(False)), now).alias("freshness"),
    ).orderBy(F.desc("score"), "card_id")


@query()
def tfidf_topk(spark, d):
    """The 25 cards nearest to every stated card (number divisible by 20) by TF-IDF cosine, against all cards."""
    own = spark.read.parquet(f"{d}/cards.parquet").select("card_id", T.vector_text(F.col("tag"), F.col("read_text"), F.col("body")).alias("text"))
    near = tfidf_neighbours(own, "card_id", "text", stated(F.col("card_id")), 25, 0.03)
    return near.select("q", "card_id", F.round("score", 6).alias("score"), "rank")


def stated(card_id):
    """Whether the number that a hexadecimal id writes is divisible by 20; other ids are no queries."""
    return F.when(card_id.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(card_id, 16, 10).cast("decimal(20,0)") % 20 == 0).otherwise(False)


@query(
    """WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS score FROM embeddings, q WHERE vec_id <> q),
    k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) SELECT q, vec_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10"""
)
def embedding_topk(spark, d):
    """The ten nearest vectors of every stated query (ids divisible by 20), against all rows."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    out = R.dense_topk(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding"), "vec_id", "q")
    return out.select("q", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH q AS (SELECT vec_id AS q, label AS ql, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS score FROM embeddings, q WHERE vec_id <> q AND label = ql)
    SELECT q, count(*) AS matches, round(max(score), 6) AS best FROM s WHERE score >= 0.35 GROUP BY q"""
)
def embedding_coverage(spark, d):
    """Whether there is evidence for a stated query within its own scope, above a floor."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label", F.col("embedding").alias("e"))
    s = v.join(q, "label").where("vec_id <> q").select("q", R.cosine(F.col("embedding"), F.col("e")).alias("score")).where("score >= 0.35")
    return s.groupBy("q").agg(F.count("*").alias("matches"), F.round(F.max("score"), 6).alias("best"))


@query(
    f"""WITH c AS {_CARDS}, a AS (SELECT card_id, row_number() OVER (ORDER BY cite_year DESC, card_id) AS rank FROM c WHERE side = 'aff' AND cite_year IS NOT NULL ORDER BY rank LIMIT 200),
    b AS (SELECT card_id, row_number() OVER (ORDER BY length(body) DESC, card_id) AS rank FROM c WHERE body IS NOT NULL ORDER BY rank LIMIT 200)
    SELECT card_id, a.rank AS lexical_rank, b.rank AS vector_rank, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b USING (card_id) ORDER BY score DESC, card_id LIMIT 50"""
)
def rrf_fusion(spark, d):
    """Two rankings fused by reciprocal rank (pools and top-k are the feature)."""
    own = cards(spark, d, "side", "cite_year", "body")
    a = own.where("side = 'aff' and cite_year is not null").select("card_id", F.col("cite_year").cast("double").alias("score")).orderBy(F.desc("score"), "card_id").limit(200)
    b = own.where("body is not null").select("card_id", F.length("body").cast("double").alias("score")).orderBy(F.desc("score"), "card_id").limit(200)
    out = R.fuse_ranks(R.ranked(a, "card_id"), R.ranked(b, "card_id"), "card_id", 1_000)
    return out.select("card_id", "lexical_rank", "vector_rank", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "card_id").limit(50)


@query()
def smart_search(spark, d):
    """A conversational request, its variants searched and fused."""
    own = corpus(spark, d, "side", "cite_year")
    return R.smart_search(own, "please find negative cards from 2015 about household savings", 25, vectors=fitted(spark, d, own)).select("card_id", F.round("score", 6).alias("score"), "confidence", F.array_join("variants", ",").alias("variants"))


@query()
def quote_verification(spark, d):
    """Whether a card's whole read text holds as a quotation of its body."""
    own = cards(spark, d, "read_text", "body").where("read_text <> '' and body is not null")
    return own.select("card_id", T.quote_holds(F.col("read_text"), F.col("body")).alias("holds")).groupBy("holds").agg(F.count("*").alias("cards"))
