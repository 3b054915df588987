"""Queries over outlines and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import graph
from citeloom.plans.registry import cards, query

_STOP = ",".join(f"'{w}'" for w in T.TITLE_STOP)
_ANS = T.ANSWER_PREFIX.replace("'", "''")


def strip_sql(col: str) -> str:
    return f"trim(regexp_replace(trim(coalesce({col}, '')), '(?i){T.SPEECH_PREFIX}', ''), ' :—–-')"


def target_sql(col: str) -> str:
    return f"CASE WHEN regexp_matches(trim({col}), '(?i){_ANS}') THEN nullif(trim(regexp_replace(trim({col}), '(?i){_ANS}', ''), ' :—–-'), '') END"


def tokens_sql(norm: str) -> str:
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w)))"


def normal_sql(col: str) -> str:
    s = strip_sql(col)
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({target_sql(s)}, {s})), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT node_id, {target_sql("title")} AS target, {normal_sql("title")} AS norm, array_to_string(list_sort({tokens_sql(normal_sql("title"))}), ' ') AS tokens FROM nodes")
def normal_titles(spark, d):
    """what a title answers, its plain form and content words."""
    n = spark.read.parquet(f"{d}/nodes.parquet")
    norm = T.normalize_title(F.col("title"))
    return n.select("node_id", T.answers_target(F.col("title")).alias("target"), norm.alias("norm"), F.array_join(F.array_sort(T.content_tokens(norm)), " ").alias("tokens"))


@query(
    f"""WITH r AS (SELECT node_id, title, {target_sql("title")} AS target FROM nodes),
    a AS (SELECT node_id AS src, target, {normal_sql("target")} AS na FROM r WHERE target IS NOT NULL), b AS (SELECT node_id AS dst, {normal_sql("title")} AS nb FROM r WHERE target IS NULL AND title IS NOT NULL),
    ua AS (SELECT DISTINCT na, {tokens_sql("na")} AS ta FROM a), ub AS (SELECT DISTINCT nb, {tokens_sql("nb")} AS tb FROM b),
    s AS (SELECT na, nb, CASE WHEN na = '' OR nb = '' THEN 0.0 WHEN na = nb THEN 1.0 WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0.0 ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END AS sim FROM ua, ub),
    p AS (SELECT src, dst, target, sim FROM a JOIN s USING (na) JOIN b USING (nb) WHERE sim >= 0.45 AND src <> dst),
    k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM p) SELECT src, dst, round(sim, 3) AS confidence, target FROM k WHERE r <= 8"""
)
def answer_edges(spark, d):
    """Which titles each answer block answers."""
    return graph.answer_edges(spark.read.parquet(f"{d}/nodes.parquet"))


DUPLICATES = rf"""WITH c AS (SELECT DISTINCT ON (card_id) card_id, lower(trim(tag)) AS tag, lower(trim(cite_author)) AS author, cite_year, string_split({normal_sql("read_text")}, ' ') AS w FROM cards WHERE cite_author IS NOT NULL AND cite_year IS NOT NULL ORDER BY card_id),
    s AS (SELECT card_id, tag, author, cite_year, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM c WHERE w[1] <> ''),
    e AS (SELECT card_id, author, cite_year, len(s) AS n, unnest(s) AS x FROM s),
    p AS (SELECT a.card_id AS src, b.card_id AS dst, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.author = b.author AND a.cite_year = b.cite_year AND a.x = b.x AND a.card_id < b.card_id GROUP BY ALL)
    SELECT src, dst, round(k / least(n, m), 3) AS confidence, (ta.tag IS DISTINCT FROM tb.tag) AS retagged FROM p JOIN s ta ON ta.card_id = src JOIN s tb ON tb.card_id = dst WHERE k / least(n, m) >= 0.8"""


@query(DUPLICATES)
def duplicate_edges(spark, d):
    """Recut cards of one author and year."""
    return graph.duplicate_edges(cards(spark, d, "tag", "cite_author", "cite_year", "read_text"))


@query(
    """WITH d AS (SELECT * FROM relate WHERE kind = 'duplicates' AND src_node_id IS NOT NULL AND dst_node_id IS NOT NULL AND src_node_id <> dst_node_id)
    SELECT src_node_id AS card_id, dst_node_id AS other FROM d UNION SELECT dst_node_id, src_node_id FROM d"""
)
def duplicates_both_ways(spark, d):
    """The duplicates of every card."""
    return graph.duplicates_both_ways(spark.read.parquet(f"{d}/relate.parquet"))


@query(
    """WITH i AS (SELECT DISTINCT card_id AS id FROM cards WHERE side = 'neg' UNION SELECT node_id FROM nodes WHERE kind = 'block' AND card_count > 10)
    SELECT DISTINCT src_node_id, dst_node_id, kind, confidence FROM relate WHERE src_node_id IN (SELECT id FROM i) OR dst_node_id IN (SELECT id FROM i)"""
)
def edges_in_scope(spark, d):
    """Edges with either end in scope."""
    ids = spark.read.parquet(f"{d}/cards.parquet").where("side = 'neg'").select(F.col("card_id").alias("id"))
    ids = ids.unionByName(spark.read.parquet(f"{d}/nodes.parquet").where("kind = 'block' and card_count > 10").select(F.col("node_id").alias("id")))
    return graph.edges_in_scope(spark.read.parquet(f"{d}/relate.parquet").select("src_node_id", "dst_node_id", "kind", "confidence"), ids)


@query(
    """WITH c AS (SELECT DISTINCT card_id, source_id, path FROM cards WHERE len(path) > 0), o AS (SELECT source_id, path, count(*) AS n FROM c GROUP BY ALL),
    s AS (SELECT source_id, path[1:d] AS path, CASE WHEN d = len(o.path) THEN n ELSE 0 END AS n FROM o, LATERAL (SELECT unnest(range(1, len(o.path) + 1)) AS d))
    SELECT source_id, array_to_string(path, ' > ') AS path, path[-1] AS title, CASE WHEN len(path) > 1 THEN array_to_string(path[1:len(path)-1], ' > ') END AS parent,
    CASE len(path) WHEN 1 THEN 'pocket' WHEN 2 THEN 'hat' ELSE 'block' END AS kind, CAST(sum(n) AS BIGINT) AS card_count FROM s GROUP BY source_id, s.path"""
)
def outline_nodes(spark, d):
    """The outline that card paths imply."""
    out = graph.outline(cards(spark, d, "source_id", "path"))
    return out.select("source_id", F.array_join("path", " > ").alias("path"), "title", F.array_join("parent", " > ").alias("parent"), "kind", "card_count")


@query(
    """SELECT node_id, title, card_count, node_id IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS has_children, (SELECT count(*) FROM nodes WHERE parent_id IS NULL) AS total
    FROM nodes WHERE parent_id IS NULL ORDER BY card_count DESC, title, node_id LIMIT 25 OFFSET 10"""
)
def outline_page(spark, d):
    """The second page of the outline's roots."""
    return graph.tree_page(spark.read.parquet(f"{d}/nodes.parquet"), limit=25, offset=10)


@query(
    """SELECT n.node_id, 'out' AS direction, r.kind, r.dst_node_id AS other_id, o.title AS other_title FROM nodes n JOIN relate r ON r.src_node_id = n.node_id LEFT JOIN nodes o ON o.node_id = r.dst_node_id
    UNION ALL SELECT n.node_id, 'in', r.kind, r.src_node_id, o.title FROM nodes n JOIN relate r ON r.dst_node_id = n.node_id LEFT JOIN nodes o ON o.node_id = r.src_node_id"""
)
def node_edges(spark, d):
    """Edges of every node in both directions, with the title at the other end."""
    n, r = spark.read.parquet(f"{d}/nodes.parquet").select("node_id", "title"), spark.read.parquet(f"{d}/relate.parquet")
    far = n.select(F.col("node_id").alias("other_id"), F.col("title").alias("other_title"))
    parts = []
    for direction, own, other in (("out", "src_node_id", "dst_node_id"), ("in", "dst_node_id", "src_node_id")):
        e = r.select(F.col(own).alias("node_id"), "kind", F.col(other).alias("other_id"))
        parts.append(n.select("node_id").join(e, "node_id").join(far, "other_id", "left").select("node_id", F.lit(direction).alias("direction"), "kind", "other_id", "other_title"))
    return parts[0].unionByName(parts[1])


@query(
    r"""SELECT src_node_id, dst_node_id, try_cast(json_extract_string(evidence, '$.retagged') AS BOOLEAN) AS retagged, json_extract_string(evidence, '$.tag_a') AS tag_a FROM relate WHERE kind = 'duplicates' AND json_valid(evidence)"""
)
def edge_evidence(spark, d):
    """what edges state in JSON; rows whose text is no JSON are left out."""
    r = spark.read.parquet(f"{d}/relate.parquet").where("kind = 'duplicates'")
    v = r.withColumn("p", T.json_payload(F.col("evidence"))).where("p is not null")
    return v.select("src_node_id", "dst_node_id", F.get_json_object("p", "$.retagged").cast("boolean").alias("retagged"), F.get_json_object("p", "$.tag_a").alias("tag_a"))
