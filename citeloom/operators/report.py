"""Details of one thing, lists, and reports as text that say what they leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import checks, graph, retrieval


def card_detail(cards: DataFrame, sources: DataFrame, edges: DataFrame, card_id: str, k: int = 10) -> dict[str, DataFrame]:
    """A card with its source, similar cards and duplicates in both directions."""
    own = cards.where(F.col("card_id") == card_id)
    return {
        "card": own,
        "source": sources.join(own.select("source_id").distinct(), "source_id", "left_semi"),
        "similar": retrieval.similar_cards(cards, card_id, k),
        "duplicates": graph.duplicates_both_ways(edges.where((F.col("src_node_id") == card_id) | (F.col("dst_node_id") == card_id))).where(F.col("card_id") == card_id),
    }


def node_detail(nodes: DataFrame, cards: DataFrame, edges: DataFrame, node_id: str) -> dict[str, DataFrame]:
    """A node with its cards in order, its edges in both directions and its children."""
    own = nodes.where(F.col("node_id") == node_id)
    return {
        "node": own,
        "cards": cards.join(own.select("source_id", "path"), ["source_id", "path"], "left_semi").orderBy("ordinal", "card_id"),
        "edges": edges.where((F.col("src_node_id") == node_id) | (F.col("dst_node_id") == node_id)),
        "children": nodes.where(F.col("parent_id") == node_id).orderBy(F.desc("card_count"), "title", "node_id"),
    }


def newest_sources(sources: DataFrame, origin: str | None = None, limit: int = 100) -> DataFrame:
    """Sources of an origin, last fetched first; what is no time comes last."""
    rows = sources if origin is None else sources.where(F.col("origin") == origin)
    return rows.orderBy(F.desc_nulls_last(F.try_to_timestamp(F.nullif(F.trim("fetched_at"), F.lit("")))), "source_id").limit(limit)


def newest_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def totals(findings: DataFrame) -> DataFrame:
    """(severity, findings, positions) of a report."""
    return findings.groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("node_id").alias("positions"))


def text(findings: DataFrame, scores: DataFrame, positions: int = 10, most: int = 5) -> str:
    """A report in plain text: the first positions and, of each kind, the first findings, with counts of the rest."""
    first = scores.orderBy(F.desc("priority"), "node_id").limit(positions).collect()
    hidden = max(0, scores.count() - len(first))
    out = ["POSITIONS"]
    out += [f"  {r.priority:.3f}  {r.title}  (cards {r.n}, support {r.support:.3f}, exposure {r.exposure:.3f})" for r in first]
    out += [f"  ... and {hidden} more"] * bool(hidden)
    rows = checks.capped(findings, most=most).orderBy("kind", "place").collect()
    for kind in dict.fromkeys(r.kind for r in rows):
        own = [r for r in rows if r.kind == kind]
        out += ["", kind.upper()] + [f"  [{r.severity}] {r.title}" for r in own] + [f"  ... and {own[0].hidden} more"] * bool(own[0].hidden)
    return "\n".join(out) + "\n"
