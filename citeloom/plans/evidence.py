"""Queries over cards, cites and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import checks, retrieval
from citeloom.plans.registry import cards, query

#: The moment against which ages are measured, so that results repeat.
NOW = "2025-06-01 00:00:00"
#: Origins that change slowly.
SLOW = ("opendebate-dataset", "dataset")
_HEDGE, _STRONG = T.FLAG_HEDGE, T.FLAG_STRONG
_RR = "CASE WHEN isnan(read_ratio) THEN 0.0 ELSE coalesce(read_ratio, 0.0) END"
_BLANK = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')) = ''"
_CARDS = "(SELECT DISTINCT ON (card_id) * FROM cards ORDER BY card_id)"


@query(
    f"""SELECT (SELECT count(*) FROM sources) AS sources, count(*) AS cards, (SELECT count(*) FROM nodes) AS nodes,
    (SELECT count(*) FROM relate) AS edges, count(*) FILTER (NOT {_BLANK.format("read_text")}) AS with_read_text, count(DISTINCT cite_author) AS authors FROM {_CARDS}"""
)
def corpus_stats(spark, d):
    """A1: sizes of the tables, cards with read text, distinct authors as written."""
    own = cards(spark, d, "read_text", "cite_author")
    counts = [spark.read.parquet(f"{d}/{t}.parquet").agg(F.count("*").alias(n)) for t, n in (("sources", "sources"), ("nodes", "nodes"), ("relate", "edges"))]
    out = own.agg(F.count("*").alias("cards"), F.count_if(~T.blank(F.col("read_text"))).alias("with_read_text"), F.countDistinct("cite_author").alias("authors"))
    for c in counts:
        out = out.crossJoin(c)  # one row each
    return out.select("sources", "cards", "nodes", "edges", "with_read_text", "authors")


@query(
    f"""SELECT c.card_id, c.side, c.cite_year, s.title AS source_title FROM {_CARDS} c LEFT JOIN sources s USING (source_id)
    WHERE c.side = 'aff' AND coalesce(c.cite_year, 0) >= 2010 AND coalesce(c.cite_year, 9999) <= 2020 AND {_RR.replace("read_ratio", "c.read_ratio")} >= 0.3
    AND contains(lower(concat_ws(' ', c.source_id, s.title, s.origin, s.path)), 'academy')"""
)
def metadata_filter(spark, d):
    """Conditions on cards and sources, met before anything is ranked."""
    own = cards(spark, d, "side", "cite_author", "cite_year", "block", "read_ratio", "source_id")
    sources = spark.read.parquet(f"{d}/sources.parquet")
    hit = retrieval.metadata_filter(own, sources, side="aff", year_min=2010, year_max=2020, min_read_ratio=0.3, source="academy")
    return hit.join(sources.select("source_id", F.col("title").alias("source_title")), "source_id", "left").select("card_id", "side", "cite_year", "source_title")


@query(
    f"""SELECT card_id, array_to_string(list_filter([CASE WHEN {_BLANK.format("read_text")} THEN 'no_read' WHEN {_RR} < 0.12 THEN 'thin_read' WHEN {_RR} > 0.92 THEN 'over_read' END,
    CASE WHEN cite_year IS NULL THEN 'undated' END,
    CASE WHEN regexp_matches(coalesce(body, ''), '(?i){_HEDGE}') AND regexp_matches(coalesce(tag, ''), '(?i){_STRONG}') AND NOT regexp_matches(coalesce(tag, ''), '(?i){_HEDGE}') THEN 'hedged_body' END], lambda x: x IS NOT NULL), ',') AS flags FROM {_CARDS}"""
)
def warrant_flags(spark, d):
    """Prompts to read a card again."""
    own = cards(spark, d, "tag", "body", "read_text", "read_ratio", "cite_year")
    flags = T.warrant_flags(*[F.col(c) for c in ("tag", "body", "read_text", "read_ratio", "cite_year")])
    return own.select("card_id", F.array_join(flags, ",").alias("flags"))


@query(
    f"""SELECT status, count(*) AS cards FROM (SELECT CASE WHEN NOT {_BLANK.format("cite_raw")} AND NOT {_BLANK.format("source_id")} THEN
    CASE WHEN NOT {_BLANK.format("read_text")} OR coalesce(disclosed_only, false) THEN 'traceable' ELSE 'attributed' END ELSE 'needs-review' END AS status FROM {_CARDS}) GROUP BY status"""
)
def evidence_status_counts(spark, d):
    """How traceable the cards are."""
    own = cards(spark, d, "cite_raw", "source_id", "read_text", "disclosed_only")
    return own.groupBy(T.evidence_status(*[F.col(c) for c in ("cite_raw", "source_id", "read_text", "disclosed_only")]).alias("status")).agg(F.count("*").alias("cards"))


@query(
    f"""WITH s AS (SELECT *, greatest(0, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(CAST(try_cast(nullif(trim(fetched_at), '') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP))) / 86400) AS BIGINT)) AS age0,
    try_cast(nullif(trim(fetched_at), '') AS TIMESTAMPTZ) IS NOT NULL AS ok FROM sources)
    SELECT source_id, CASE WHEN ok THEN age0 END AS age_days, CASE WHEN trim(coalesce(last_refresh_failed_at, '')) <> '' THEN 'refresh-failed' WHEN NOT ok THEN 'unknown'
    WHEN age0 >= CASE WHEN origin IN ('opendebate-dataset', 'dataset') THEN 90 ELSE 30 END THEN 'stale' ELSE 'fresh' END AS freshness FROM s"""
)
def source_freshness(spark, d):
    """how old each source is, against a stated moment."""
    s = spark.read.parquet(f"{d}/sources.parquet")
    now = F.lit(NOW).cast("timestamp")
    slow = F.coalesce(F.col("origin").isin(*SLOW), F.lit(False))
    return s.select("source_id", T.age_days(F.col("fetched_at"), now).alias("age_days"), T.source_freshness(F.col("fetched_at"), F.col("last_refresh_failed_at"), slow, now).alias("freshness"))


@query(
    f"""SELECT source_id, count(*) AS cards, count(*) FILTER (NOT {_BLANK.format("read_text")}) AS with_read, round(count(*) FILTER (NOT {_BLANK.format("read_text")}) / count(*), 6) AS coverage,
    count(*) FILTER ({_RR} > 0 AND {_RR} < 0.12) AS thin, round(median(CASE WHEN {_RR} > 0 THEN {_RR} END), 6) AS median_ratio FROM {_CARDS} GROUP BY source_id"""
)
def read_health_by_source(spark, d):
    """Coverage of read text and its ratios per source."""
    rr = checks.clean_ratio()
    own = cards(spark, d, "source_id", "read_text", "read_ratio")
    has = F.count_if(~T.blank(F.col("read_text")))
    return own.groupBy("source_id").agg(
        F.count("*").alias("cards"), has.alias("with_read"), F.round(has / F.count("*"), 6).alias("coverage"), F.count_if((rr > 0) & (rr < 0.12)).alias("thin"), F.round(F.median(F.when(rr > 0, rr)), 6).alias("median_ratio")
    )


@query(
    f"""SELECT s.source_id, s.title, n, filled FROM (SELECT source_id, count(*) AS n, count(*) FILTER (NOT {_BLANK.format("body")}) AS filled FROM {_CARDS} GROUP BY source_id) c
    JOIN sources s USING (source_id) WHERE n >= 3 AND (n - filled) / n >= 0.02"""
)
def sparse_sources(spark, d):
    """Sources with many cards without a body (the share is a parameter; templates have 0.9)."""
    return checks.template_sources(cards(spark, d, "source_id", "body"), spark.read.parquet(f"{d}/sources.parquet"), share=0.02)


@query(
    """SELECT DISTINCT cite_author, coalesce(list_filter(string_split(trim(regexp_replace(regexp_replace(split_part(translate(lower(cite_author), '""" + T.ACCENTED + """', '""" + T.PLAIN + """'), ',', 1), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
    lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains([""" + ",".join(f"'{w}'" for w in T.HONORIFIC + T.INSTITUTION) + """], t))[-1], '') AS author_key FROM cards WHERE cite_author IS NOT NULL"""
)
def author_keys(spark, d):
    """the surname by which spellings of an author meet."""
    own = spark.read.parquet(f"{d}/cards.parquet").where("cite_author is not null").select("cite_author").distinct()
    return own.select("cite_author", T.author_key(F.col("cite_author")).alias("author_key"))


@query(
    r"""WITH c AS (SELECT DISTINCT trim(cite_raw) AS raw FROM cards WHERE cite_raw IS NOT NULL),
    y AS (SELECT raw, CAST(coalesce(nullif(regexp_extract(raw[1:80], '(?:^|[^0-9/-])[''‘’]?((?:19|20)[0-9]{2}|[0-9]{2})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(raw, '(?:^|[^0-9/-])[''‘’]?((?:19|20)[0-9]{2}|[0-9]{2})(?:[^0-9]|$)', 1), '')) AS INT) AS v FROM c)
    SELECT raw, CASE WHEN v >= 1900 THEN v WHEN v >= 90 THEN v + 1900 ELSE v + 2000 END AS year, trim(nullif(regexp_extract(raw, '["“]([^"”]{6,200})["”]', 1), '')) AS title,
    rtrim(nullif(regexp_extract(raw, '(https?://[^\s)\]>,]+)', 1), ''), '.,;') AS url FROM y"""
)
def cite_fields(spark, d):
    """F8: year, quoted title and URL of every distinct source line (author, credentials and publication: see the tests)."""
    own = spark.read.parquet(f"{d}/cards.parquet").where("cite_raw is not null").select(F.trim("cite_raw").alias("raw")).distinct()
    return own.select("raw", T.cite_year(F.col("raw")).alias("year"), T.cite_title(F.col("raw")).alias("title"), T.cite_url(F.col("raw")).alias("url"))


@query()
def parsed_cites(spark, d):
    """All fields of every distinct source line, and whether it reads like one."""
    own = spark.read.parquet(f"{d}/cards.parquet").where("cite_raw is not null").select("cite_raw").distinct()
    return own.select("cite_raw", T.parse_cite(F.col("cite_raw")).alias("p"), T.looks_like_cite(F.col("cite_raw")).alias("is_cite")).select("cite_raw", "p.*", "is_cite")


@query(
    f"""SELECT coalesce(list_filter(string_split(replace(source_path, '\\', '/'), '/'), lambda p: p <> '')[-2], source_id) AS owner, count(*) AS cards FROM {_CARDS} GROUP BY 1"""
)
def cards_by_owner(spark, d):
    """cards per owner, the folder of their file."""
    return cards(spark, d, "source_path", "source_id").groupBy(T.owner_of(F.col("source_path"), F.col("source_id")).alias("owner")).agg(F.count("*").alias("cards"))


@query(
    f"""SELECT card_id, CASE WHEN a > n THEN 'aff' WHEN n > a THEN 'neg' ELSE 'unknown' END AS side FROM (SELECT card_id,
    len(regexp_extract_all(hay, '{T.AFF_MARKS}')) AS a, len(regexp_extract_all(hay, '{T.NEG_MARKS}')) AS n FROM (SELECT card_id, lower(concat_ws(' ', array_to_string(path, ' '), tag)) AS hay FROM {_CARDS}))"""
)
def inferred_sides(spark, d):
    """the side that a card's outline suggests."""
    return cards(spark, d, "path", "tag").select("card_id", T.infer_side(F.col("path"), F.col("tag")).alias("side"))


@query(
    f"""WITH b AS (SELECT card_id, cite_year, coalesce(nullif(lower(regexp_replace(regexp_extract(coalesce(nullif(trim(cite_author), ''), 'unknown'), '(\\S+)$', 1), '[^A-Za-z]', '', 'g')), ''), 'unknown') || coalesce(CAST(nullif(cite_year, 0) AS VARCHAR), 'nodate') AS base FROM {_CARDS}),
    k AS (SELECT card_id, base, row_number() OVER (PARTITION BY base ORDER BY card_id) - 1 AS i FROM b)
    SELECT card_id, base || CASE WHEN i = 0 THEN '' WHEN i <= 26 THEN chr(CAST(96 + i AS INT)) ELSE CAST(i AS VARCHAR) END AS bibtex_key FROM k"""
)
def bibtex_keys(spark, d):
    """Keys of author and year with a suffix on repeats."""
    from citeloom.sources.packet import bibtex_keys as keys

    return keys(cards(spark, d, "cite_author", "cite_year")).select("card_id", "bibtex_key")


@query(
    f"""SELECT side, count(*) AS cards, sum(CASE WHEN {_BLANK.format("read_text")} THEN 0 ELSE 1 END) AS with_read, min(cite_year) AS oldest, max(cite_year) AS newest FROM (SELECT *
    REPLACE (CASE WHEN side IN ('aff', 'neg', 'both') THEN side ELSE 'unknown' END AS side) FROM {_CARDS}) GROUP BY side"""
)
def packet_summary(spark, d):
    """K9, A5: what a packet of all cards holds per side."""
    side = F.when(F.col("side").isin("aff", "neg", "both"), F.col("side")).otherwise("unknown")
    own = cards(spark, d, "side", "read_text", "cite_year")
    return own.groupBy(side.alias("side")).agg(F.count("*").alias("cards"), F.count_if(~T.blank(F.col("read_text"))).alias("with_read"), F.min("cite_year").alias("oldest"), F.max("cite_year").alias("newest"))
