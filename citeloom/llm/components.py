"""Connected groups from pairwise matches.

Minimum labels are propagated over the edges, label chains are shortened by pointer
jumping, and the graph is contracted to the surviving labels.  Every round is written
to the shared checkpoint folder.  The number of groups at least halves per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.skew import lookup_join
from citeloom.staging import drop_staged, stage


def connected_components(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """One row (node_id, group_id) per node of a pair; group_id is the smallest id of the group.

    Pairs with a null end or equal ends, and repeats in either direction, add nothing.
    No usable pair gives an empty table.  Other columns are ignored.
    """
    edges = (
        pairs.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") < F.col("b")))
        .distinct()
    )
    edges = stage(edges, "cc-edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node_id")).agg(F.min("b").alias("m"))
        parents = stage(parents.select("node_id", F.least("node_id", "m").alias("group_id")), "cc-parent")
        parents = _jump(parents)
        if labels is None:
            new = parents
        else:
            step = parents.select(F.col("node_id").alias("group_id"), F.col("group_id").alias("up"))
            new = stage(
                lookup_join(labels, step, ["group_id"], "left").select("node_id", F.coalesce("up", "group_id").alias("group_id")),
                "cc-label",
            )
            drop_staged(labels)
        up_a = parents.select(F.col("node_id").alias("a"), F.col("group_id").alias("ra"))
        up_b = parents.select(F.col("node_id").alias("b"), F.col("group_id").alias("rb"))
        moved = lookup_join(lookup_join(edges, up_a, ["a"]), up_b, ["b"])
        rest = stage(
            moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "cc-edges",
        )
        drop_staged(edges)
        if new is not parents and labels is not None:
            drop_staged(parents)
        labels, edges = new, rest
        if edges.isEmpty():
            return labels


def _jump(parents: DataFrame) -> DataFrame:
    """Double the pointers until every node points at a root (a node that points at itself)."""
    while True:
        up = parents.select(F.col("node_id").alias("group_id"), F.col("group_id").alias("up"))
        nxt = stage(
            lookup_join(parents, up, ["group_id"]).select("node_id", F.col("up").alias("group_id"), (F.col("up") != F.col("group_id")).alias("moved")),
            "cc-jump",
        )
        drop_staged(parents)
        moved = not nxt.where("moved").isEmpty()
        path = nxt._staged_path
        parents = nxt.drop("moved")
        parents._staged_path = path
        if not moved:
            return parents
