"""Queries over changing tables, ingest and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import store
from citeloom.plans.registry import cards, query
from citeloom.sources import dataset, policy


@query(
    """SELECT job_id, state, processed, imported, updated_at FROM (SELECT DISTINCT ON (job_id) * FROM ingest_jobs WHERE job_id IS NOT NULL ORDER BY job_id, updated_at DESC,
    struct_pack(url, license, state, processed, total, imported, cards_added, skipped, failed, error, d := details[1:5], created_at) DESC)"""
)
def latest_jobs(spark, d):
    """K6, T-2: the last state of every job."""
    return store.latest_jobs(spark.read.parquet(f"{d}/ingest_jobs.parquet")).select("job_id", "state", "processed", "imported", "updated_at")


@query(
    """WITH l AS (SELECT DISTINCT ON (job_id) * FROM ingest_jobs WHERE job_id IS NOT NULL ORDER BY job_id, updated_at DESC,
    struct_pack(url, license, state, processed, total, imported, cards_added, skipped, failed, error, d := details[1:5], created_at) DESC)
    SELECT CASE WHEN state IN ('queued', 'discovering', 'importing', 'cancelling') THEN 'failed' ELSE state END AS state, count(*) AS jobs FROM l GROUP BY 1"""
)
def recovered_jobs(spark, d):
    """K6: states after a restart, when live jobs have failed."""
    return store.recover_jobs(store.latest_jobs(spark.read.parquet(f"{d}/ingest_jobs.parquet"))).groupBy("state").agg(F.count("*").alias("jobs"))


@query(
    """WITH doomed AS (SELECT source_id FROM sources WHERE origin = 'local'), c AS (SELECT DISTINCT card_id, source_id FROM cards),
    gone AS (SELECT node_id AS id FROM nodes WHERE source_id IN (SELECT * FROM doomed) UNION SELECT card_id FROM c WHERE source_id IN (SELECT * FROM doomed))
    SELECT 'cards' AS part, count(*) AS n FROM c WHERE source_id IS NULL OR source_id NOT IN (SELECT * FROM doomed) UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE source_id IS NULL OR source_id NOT IN (SELECT * FROM doomed)
    UNION ALL SELECT 'sources', count(*) FROM sources WHERE source_id NOT IN (SELECT * FROM doomed)
    UNION ALL SELECT 'edges', count(*) FROM relate WHERE (src_node_id IS NULL OR src_node_id NOT IN (SELECT id FROM gone)) AND (dst_node_id IS NULL OR dst_node_id NOT IN (SELECT id FROM gone))"""
)
def cascade_delete(spark, d):
    """K3: what remains after the sources of one origin go."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("sources", "nodes", "relate")}
    left = store.delete_sources(t["sources"].where("origin = 'local'"), t["sources"], cards(spark, d, "source_id"), t["nodes"], t["relate"])
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """WITH e AS (SELECT DISTINCT card_id FROM cards WHERE side = 'aff'), i AS (SELECT DISTINCT card_id, cite_year FROM cards WHERE cite_year >= 2015) SELECT card_id, cite_year FROM i WHERE card_id NOT IN (SELECT card_id FROM e)"""
)
def insert_if_absent(spark, d):
    """Incoming cards that are not there yet."""
    own = cards(spark, d, "side", "cite_year")
    return store.insert_if_absent(own.where("side = 'aff'").select("card_id"), own.where("cite_year >= 2015").select("card_id", "cite_year"), "card_id")


@query("SELECT card_id, max(ingested_at) AS ingested_at FROM cards GROUP BY card_id")
def latest_deliveries(spark, d):
    """K2: the last delivery of every card."""
    return store.latest_rows(spark.read.parquet(f"{d}/cards.parquet").select("card_id", "ingested_at"), ["card_id"], ["ingested_at"])


@query("SELECT count(*) AS n, CAST(CAST(sum(CAST('0x' || md5(card_id)[1:12] AS BIGINT)) AS HUGEINT) AS VARCHAR) AS mark FROM (SELECT DISTINCT card_id FROM cards)")
def corpus_fingerprint(spark, d):
    """Size and mark of the corpus, by which an index knows that it is stale."""
    return store.fingerprint(spark.read.parquet(f"{d}/cards.parquet"), "card_id")


@query(
    """WITH r AS (SELECT DISTINCT ON (id) * FROM opendebate_rows ORDER BY id), k AS (SELECT * FROM r WHERE trim(regexp_replace(coalesce(spoken, ''), '\\s+', ' ', 'g')) <> '' AND event IN ('cx', 'ld') AND (year IS NULL OR year BETWEEN 2010 AND 2020) AND (duplicatecount IS NULL OR duplicatecount >= 2))
    SELECT id, CASE WHEN lower(trim(side)) IN ('a', 'aff', 'affirmative') THEN 'aff' WHEN lower(trim(side)) IN ('n', 'neg', 'negative') THEN 'neg' ELSE 'unknown' END AS side,
    array_to_string(list_filter([nullif(trim(pocket), ''), nullif(trim(hat), ''), nullif(trim(block), '')], lambda x: x IS NOT NULL), ' > ') AS path FROM k"""
)
def dataset_cards(spark, d):
    """Rows of the dataset as cards, under its filter."""
    rows = dataset.filter_rows(spark.read.parquet(f"{d}/opendebate_rows.parquet"), events=["cx", "ld"], year_min=2010, year_max=2020, min_duplicates=2)
    return dataset.to_cards(rows, "ode:5c1e90d7").select(F.col("ordinal").alias("id"), "side", F.array_join("path", " > ").alias("path"))


@query(
    r"""SELECT source_id, lower(regexp_extract(trim(url), '^[a-z]+://([^/:?#]+)', 1)) AS host, CASE WHEN regexp_matches(lower(regexp_extract(trim(url), '^[a-z]+://([^/:?#]+)', 1)), '(^|\.)lumwick\.example$') THEN 'open'
    WHEN regexp_matches(lower(regexp_extract(trim(url), '^[a-z]+://([^/:?#]+)', 1)), '(^|\.)osmar\.example$') THEN 'attributed' ELSE 'refused' END AS tier FROM sources WHERE url IS NOT NULL AND trim(url) <> ''"""
)
def host_policy(spark, d):
    """what may be fetched from a source's host; unknown hosts are refused."""
    rules = spark.createDataFrame([("lumwick.example", "open"), ("osmar.example", "attributed")], "host string, tier string")
    s = spark.read.parquet(f"{d}/sources.parquet").where("url is not null and trim(url) <> ''").select("source_id", "url")
    return policy.check_urls(s, rules, "url").select("source_id", "host", "tier")


@query("SELECT source_id, url FROM sources WHERE url IS NOT NULL AND regexp_matches(lower(url), '/[0-9]+$') AND coalesce(origin, '') <> 'local'")
def refreshable_sources(spark, d):
    """Sources that can be fetched again."""
    s = spark.read.parquet(f"{d}/sources.parquet")
    return s.where(F.col("url").isNotNull() & F.lower("url").rlike("/[0-9]+$") & (F.coalesce("origin", F.lit("")) != "local")).select("source_id", "url")


@query(
    """WITH c AS (SELECT DISTINCT card_id, source_id FROM cards) SELECT c.card_id, c.source_id FROM c WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)"""
)
def cards_without_source(spark, d):
    """Cards whose source is not recorded."""
    own = cards(spark, d, "source_id").where("source_id is not null")
    return own.join(spark.read.parquet(f"{d}/sources.parquet").select("source_id"), "source_id", "left_anti").select("card_id", "source_id")


@query()
def round_contexts(spark, d):
    """the round line of dataset rows, without NA."""
    r = spark.read.parquet(f"{d}/opendebate_rows.parquet")
    return r.select("id", dataset.round_context("tournament", "round", "opponent", "judge").alias("context"), T.short_cite(F.col("cite"), F.col("year"), F.col("fullcite")).alias("short")).distinct()
