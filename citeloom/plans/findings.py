"""Queries over positions and their findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import checks, graph
from citeloom.plans import graphs
from citeloom.plans.evidence import _BLANK, _CARDS, _RR
from citeloom.plans.graphs import target_sql
from citeloom.plans.registry import cards, query
from citeloom.staging import stage

_COLS = ("source_id", "source_path", "path", "side", "cite_year", "tag", "read_ratio", "read_text", "body", "disclosed_only", "cite_author", "cite_raw", "cite_pub")
#: Words that claim much in the tags of these tables, where the usual ones don't occur.
CLAIM = r"\b(undermines?|displaces?|outpaces?|offsets?|stabilises?|exposes?|constrains?|crowds? out)\b"
_H, _S, _Q = T.HEDGE, CLAIM, T.QUALIFICATION
#: Facts of cards and places of positions, as the SQL of several queries.
_FACTS = f"""f AS (SELECT card_id, source_id, source_path, path, side, cite_year, {_RR} AS rr, {_BLANK.format("read_text")} AS unread, coalesce(disclosed_only, false) AS disclosed,
    NOT regexp_matches(coalesce(cite_raw, ''), '(?i){_Q}') AND {_BLANK.format("cite_pub")} AS unqualified, {_BLANK.format("cite_author")} AS anonymous,
    CASE WHEN regexp_matches(coalesce(tag, ''), '(?i){_S}') THEN
      (CASE WHEN coalesce(read_text, '') <> '' AND regexp_matches(read_text, '(?i){_H}') AND NOT regexp_matches(coalesce(tag, ''), '(?i){_H}') THEN 1 ELSE 0 END)
      + (CASE WHEN NOT coalesce(disclosed_only, false) AND {_RR} > 0 AND {_RR} < 0.15 THEN 1 ELSE 0 END)
      + (CASE WHEN NOT coalesce(disclosed_only, false) AND {_BLANK.format("read_text")} THEN 1 ELSE 0 END)
      + (CASE WHEN NOT coalesce(disclosed_only, false) AND coalesce(body, '') <> '' AND regexp_matches(body, '(?i){_H}') AND coalesce(read_text, '') <> '' AND NOT regexp_matches(read_text, '(?i){_H}') THEN 1 ELSE 0 END)
      ELSE 0 END AS overclaims FROM {_CARDS}),
    pl AS (SELECT node_id, title, source_id, path FROM nodes WHERE card_count > 0 AND {target_sql("title")} IS NULL),
    loc AS (SELECT node_id, title, f.* FROM pl JOIN f USING (source_id, path))"""
_PER = "p AS (SELECT node_id, title, count(*) AS n, count(*) FILTER (unqualified) AS unq, count(*) FILTER (NOT disclosed AND unread) AS unread, count(*) FILTER (NOT disclosed AND NOT unread AND rr > 0 AND rr < 0.12) AS thin, max(cite_year) AS newest FROM loc GROUP BY ALL)"


def card_facts(spark, d):
    """Facts of distinct cards: texts become flags first, so it is narrow rows whose repeats are removed."""
    return checks.card_facts(spark.read.parquet(f"{d}/cards.parquet").select("card_id", *_COLS), claim=CLAIM).distinct()


def _inputs(spark, d):
    nodes = spark.read.parquet(f"{d}/nodes.parquet")
    return nodes, checks.positions(nodes), stage(card_facts(spark, d), "facts")


def _slim(findings):
    return findings.select("kind", "severity", "node_id", "cards")


@query(
    f"""WITH {_FACTS}, {_PER}, c AS (SELECT max(cite_year) AS corpus FROM f)
    SELECT 'single_card_contention' AS kind, 'major' AS severity, node_id, n AS cards FROM p WHERE n = 1
    UNION ALL SELECT 'qualification_gap', CASE WHEN (n = 1 OR unq / n >= 0.75) AND n <= 2 THEN 'major' ELSE 'minor' END, node_id, unq FROM p WHERE unq > 0 AND (n = 1 OR unq / n >= 0.5)
    UNION ALL SELECT 'no_read_text', 'major', node_id, unread FROM p WHERE unread > 0
    UNION ALL SELECT 'thin_read', 'minor', node_id, thin FROM p WHERE thin > 0
    UNION ALL SELECT 'recency_decay', CASE WHEN corpus - newest >= 6 THEN 'major' ELSE 'minor' END, node_id, n FROM p, c WHERE corpus - newest >= 3"""
)
def position_checks(spark, d):
    """Q-2, Q-4 to Q-7, A5, A7, J6: checks that one grouped pass over positions answers."""
    _, places, facts = _inputs(spark, d)
    p = checks.position_facts(places, facts)
    return _slim(checks.checked(p, facts, ["single_card_contention", "qualification_gap", "no_read_text", "thin_read", "recency_decay"]))


@query(f"WITH {_FACTS} SELECT 'power_tagging' AS kind, CASE WHEN overclaims > 1 OR unread THEN 'major' ELSE 'minor' END AS severity, node_id FROM loc WHERE overclaims > 0")
def power_tagging(spark, d):
    """Q-3: tags that claim more than the read text gives."""
    _, places, facts = _inputs(spark, d)
    return checks.power_tagging(places, facts).select("kind", "severity", "node_id")


@query(
    f"""WITH {_FACTS} SELECT kind, node_id, card_id FROM (SELECT 'no_read_text' AS kind, node_id, card_id FROM loc WHERE NOT disclosed AND unread
    UNION ALL SELECT 'thin_read', node_id, card_id FROM loc WHERE NOT disclosed AND NOT unread AND rr > 0 AND rr < 0.12)"""
)
def finding_cards(spark, d):
    """Q-5, Q-6: the cards that findings about read text speak of, as rows."""
    _, places, facts = _inputs(spark, d)
    p = checks.position_facts(places, facts)
    return checks.finding_cards(checks.checked(p, facts, ["no_read_text", "thin_read"]), places, facts)


@query()
def source_concentration(spark, d):
    """Q-1, A3, F12, F13: positions that rest on few authors for their cards, whose spellings are merged."""
    _, places, facts = _inputs(spark, d)
    return _slim(checks.checked(checks.position_facts(places, facts), facts, ["source_concentration"], concentrated=0.9))


@query(
    f"""WITH pl AS (SELECT node_id FROM nodes WHERE card_count > 0 AND {target_sql("title")} IS NULL), a AS (SELECT DISTINCT src_node_id AS attacker, dst_node_id AS node_id FROM relate WHERE kind = 'answers'),
    o AS (SELECT a.node_id, lower(n.title) AS name FROM a JOIN nodes n ON n.node_id = a.attacker WHERE a.attacker NOT IN (SELECT dst_node_id FROM relate WHERE kind = 'answers' AND dst_node_id IS NOT NULL))
    SELECT 'answer_gap' AS kind, CASE WHEN count(DISTINCT name) >= 2 THEN 'major' ELSE 'minor' END AS severity, node_id FROM pl JOIN o USING (node_id) GROUP BY node_id"""
)
def answer_gap(spark, d):
    """Q-9, J9, J5: positions attacked by what nothing answers."""
    nodes, places, _ = _inputs(spark, d)
    return checks.answer_gap(places, spark.read.parquet(f"{d}/relate.parquet"), nodes).select("kind", "severity", "node_id")


@query(
    f"""WITH {_FACTS}, {_PER} SELECT node_id, n FROM p WHERE n >= 2 AND node_id NOT IN (SELECT dst_node_id FROM relate WHERE kind = 'answers' AND dst_node_id IS NOT NULL)
    AND EXISTS (SELECT 1 FROM relate WHERE kind = 'answers' AND dst_node_id IS NOT NULL)"""
)
def unanswered_positions(spark, d):
    """Q-10, J10: positions with cards that no answer points at."""
    _, places, facts = _inputs(spark, d)
    found = checks.unanswered_positions(places, checks.position_facts(places, facts), spark.read.parquet(f"{d}/relate.parquet"))
    return found.select("node_id", F.col("cards").alias("n"))


@query(
    f"""WITH k AS (SELECT coalesce(list_filter(string_split(replace(source_path, '\\', '/'), '/'), lambda p: p <> '')[-2], source_id) AS owner, side,
    coalesce(list_filter(string_split(trim(regexp_replace(regexp_replace(split_part(translate(lower(cite_author), '{T.ACCENTED}', '{T.PLAIN}'), ',', 1), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
      lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains([{",".join(f"'{w}'" for w in T.HONORIFIC + T.INSTITUTION)}], t))[-1], '') AS author FROM {_CARDS} WHERE NOT {_BLANK.format("cite_author")})
    SELECT owner, author, count(*) FILTER (side = 'aff') AS aff, count(*) FILTER (side = 'neg') AS neg FROM k WHERE author <> '' AND owner IS NOT NULL GROUP BY ALL HAVING aff > 0 AND neg > 0"""
)
def self_contradiction(spark, d):
    """Q-11, J16: owners who read one author on both sides."""
    return checks.self_contradiction(card_facts(spark, d))


@query(f"WITH e AS ({graphs.DUPLICATES}) SELECT count(*) AS edges, count(*) FILTER (retagged) AS retagged FROM e HAVING count(*) >= 3 AND count(*) FILTER (retagged) >= 2")
def duplicate_bloat(spark, d):
    """Q-12: whether a corpus keeps many recut cards under other tags."""
    e = graph.duplicate_edges(cards(spark, d, "tag", "cite_author", "cite_year", "read_text"))
    return checks.duplicate_bloat(e)


def _scored(spark, d):
    """(nodes, places, facts, p, findings of positions, template sources), without the positions of templates."""
    nodes = spark.read.parquet(f"{d}/nodes.parquet")
    facts = stage(card_facts(spark, d), "facts")
    flags = spark.read.parquet(f"{d}/cards.parquet").select("card_id", "source_id", F.when(~T.blank(F.col("body")), "x").alias("body")).distinct()
    templates = stage(checks.template_sources(flags, spark.read.parquet(f"{d}/sources.parquet")), "templates")
    places = checks.positions(nodes, None, templates)
    p = stage(checks.position_facts(places, facts), "positions")
    return nodes, places, facts, p, checks.position_findings(places, p, facts), templates


@query()
def position_scores(spark, d):
    """Q-13 to Q-16, A6, A9, L4: support, exposure and priority of every position, by the findings about positions alone."""
    _, _, _, p, findings, _ = _scored(spark, d)
    return checks.scores(p, findings)


_TEMPLATES = f"""tm AS (SELECT source_id FROM {_CARDS} JOIN (SELECT DISTINCT source_id FROM sources) USING (source_id) GROUP BY source_id HAVING count(*) >= 3 AND count(*) FILTER ({_BLANK.format("body")}) / count(*) >= 0.9)"""


@query(
    f"""WITH {_FACTS}, {_TEMPLATES}, lo AS (SELECT * FROM loc WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM tm)), c AS (SELECT max(cite_year) AS corpus FROM f),
    p AS (SELECT node_id, count(*) AS n, count(*) FILTER (unqualified) AS unq, count(*) FILTER (NOT disclosed AND unread) AS unread, count(*) FILTER (NOT disclosed AND NOT unread AND rr > 0 AND rr < 0.12) AS thin, max(cite_year) AS newest FROM lo GROUP BY node_id),
    x AS (SELECT node_id, CASE WHEN n = 1 THEN 0.45 END AS w FROM p UNION ALL SELECT node_id, CASE WHEN (n = 1 OR unq / n >= 0.75) AND n <= 2 THEN 0.45 ELSE 0.15 END FROM p WHERE unq > 0 AND (n = 1 OR unq / n >= 0.5)
      UNION ALL SELECT node_id, 0.45 FROM p WHERE unread > 0 UNION ALL SELECT node_id, 0.15 FROM p WHERE thin > 0 UNION ALL SELECT node_id, CASE WHEN corpus - newest >= 6 THEN 0.45 ELSE 0.15 END FROM p, c WHERE corpus - newest >= 3
      UNION ALL SELECT node_id, CASE WHEN overclaims > 1 OR unread THEN 0.45 ELSE 0.15 END FROM lo WHERE overclaims > 0),
    r AS (SELECT node_id, sum(w) AS raw FROM x GROUP BY node_id)
    SELECT node_id, n, round(1 - 1 / (1 + coalesce(raw, 0)), 3) AS exposure FROM p LEFT JOIN r USING (node_id)"""
)
def position_exposure(spark, d):
    """Q-15, A9: how exposed every position is, by all findings about it but those on the concentration of authors."""
    _, _, _, p, findings, _ = _scored(spark, d)
    return checks.scores(p, findings.where("kind <> 'source_concentration'")).select("node_id", "n", "exposure")


@query()
def findings_report(spark, d):
    """W4, W5, A10, L3, Q-8, Q-12: the first findings of every kind, about positions and the corpus, with how many are hidden (the cap is the feature)."""
    nodes, places, facts, p, findings, templates = _scored(spark, d)
    duplicates = graph.duplicate_edges(cards(spark, d, "tag", "cite_author", "cite_year", "read_text"))
    found = findings.unionByName(checks.corpus_findings(places, p, facts, spark.read.parquet(f"{d}/relate.parquet"), nodes, templates, duplicates))
    return checks.capped(found).select("kind", "place", "severity", "title", "hidden")


@query(
    f"""WITH s AS (SELECT source_id FROM sources WHERE contains(lower(concat_ws(' ', path, title)), 'prep')), pl AS (SELECT n.node_id, n.title, n.source_id FROM nodes n WHERE card_count > 0 AND {target_sql("title")} IS NULL)
    SELECT node_id, title, source_id FROM pl WHERE source_id IN (SELECT source_id FROM s)"""
)
def scoped_positions(spark, d):
    """Positions of one owner; an owner that matches nothing has none."""
    nodes = spark.read.parquet(f"{d}/nodes.parquet")
    return checks.positions(nodes, checks.scope_of(spark.read.parquet(f"{d}/sources.parquet"), "prep")).select("node_id", "title", "source_id")


@query(
    f"""WITH {_FACTS}, k AS (SELECT node_id, side, count(*) AS n, min(card_id) AS first FROM loc WHERE side IS NOT NULL AND side <> 'unknown' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, first) AS k FROM k) SELECT node_id, side, n FROM r WHERE k = 1"""
)
def position_sides(spark, d):
    """The most frequent known side of a position; of equal ones the one of the smallest card."""
    _, places, facts = _inputs(spark, d)
    at = places.join(facts, ["source_id", "path"]).where("side is not null and side <> 'unknown'")
    per = at.groupBy("node_id", "side").agg(F.count("*").alias("n"), F.min("card_id").alias("first"))
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("n"), "first"))
    return per.withColumn("k", k).where("k = 1").select("node_id", "side", "n")
