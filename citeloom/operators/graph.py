"""Edges between titles and between cards, and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.skew import lookup_join
from citeloom.staging import stage


def answer_edges(nodes: DataFrame, least: float = 0.45, most: int = 8) -> DataFrame:
    """(src, dst, confidence, target): which titles each answer block answers, at most ``most`` per block.

    Candidates share a content token (or the whole normalised title), so titles without
    either never meet.  Blocks with the same target and nodes with the same title are
    compared once.  Answer blocks are no targets.  Ties go to the smaller node id.

    Two titles of n and m tokens need ``o`` common ones to be similar enough.  Then the first
    ``n - o + k`` and ``m - o + k`` tokens, in one order, have ``k`` in common, so titles are
    joined on these and both sizes, with ``k`` up to three: not on every word they share.
    """
    rows = stage(nodes.select("node_id", "title", T.answers_target(F.col("title")).alias("target")).withColumn("norm", T.normalize_title(F.coalesce("target", "title"))), "titles")
    asks, gives = rows.where("target is not null"), rows.where("target is null and title is not null")
    a, b = (stage(x.select("norm").distinct().withColumn("tokens", F.array_sort(T.content_tokens(F.col("norm")))).withColumn("n", F.size("tokens")), "title-sets") for x in (asks, gives))
    ka, kb = title_keys(a, b, least), title_keys(b, a, least)
    ka = ka.select(F.col("norm").alias("na"), F.col("tokens").alias("ta"), F.col("n").alias("sa"), F.col("m").alias("sb"), "o", "k", "t")
    kb = kb.select(F.col("norm").alias("nb"), F.col("tokens").alias("tb"), F.col("n").alias("sb"), F.col("m").alias("sa"), "t")
    # every pair is kept at its first common tokens only, so no distinct over pairs is needed
    met = ka.join(kb, ["sa", "sb", "t"]).withColumn("common", F.array_intersect("ta", "tb"))
    pairs = met.where((F.size("common") >= F.col("o")) & (F.col("t") == F.array_join(F.slice("common", F.lit(1), F.col("k")), " "))).select("na", "nb", "ta", "tb")
    # titles of no token are similar to themselves only
    bare = a.where("n = 0 and norm <> ''").select(F.col("norm").alias("na"), F.col("tokens").alias("ta")).join(b.where("n = 0").select(F.col("norm").alias("nb"), F.col("tokens").alias("tb")), F.col("na") == F.col("nb"))
    scored = pairs.unionByName(bare).select("na", "nb", T.title_similarity(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb")).alias("s")).where(F.col("s") >= least)
    # equal scores of one title go by node id, so no more than ``most`` nodes of it can count
    first = gives.withColumn("k", F.row_number().over(W.partitionBy("norm").orderBy("node_id"))).where(F.col("k") <= most + 1)
    targets = first.select("norm", F.col("node_id").alias("dst")).withColumnRenamed("norm", "nb")
    best = scored.join(targets, "nb").withColumn("k", F.row_number().over(W.partitionBy("na").orderBy(F.desc("s"), "dst"))).where(F.col("k") <= most + 1)
    edges = asks.select(F.col("node_id").alias("src"), "target", F.col("norm").alias("na")).join(best, "na").where("src <> dst")
    ranked = edges.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("s"), "dst"))).where(F.col("k") <= most)
    return ranked.select("src", "dst", F.round("s", 3).alias("confidence"), "target")


def title_keys(titles: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(the columns of ``titles``, m, o, k, t): of each set of n tokens, for every size m of ``others`` that can be similar, the ``o`` tokens needed and all ``k`` of its first n - o + k."""
    n, m, o = F.col("n"), F.col("m"), F.col("o")
    sizes = F.broadcast(others.where("n > 0").select(F.col("n").alias("m")).distinct())  # one row per size
    # by number, since the sets are small and their keys are not: else one task would list all of them
    rows = titles.repartition(titles.sparkSession.sparkContext.defaultParallelism).join(sizes, (n >= m * least - 1e-9) & (m >= n * least - 1e-9)).withColumn("o", F.greatest(F.ceil(least * (n + m) / (1 + least) - 1e-9), F.lit(1)).cast("int"))
    # k is one number for both sides, and smaller where there would be too many of three or two
    spare = F.greatest(n, m) - o
    rows = rows.where(o <= F.least(n, m)).withColumn("k", F.when((o >= 3) & (spare <= 7), 3).when((o >= 2) & (spare <= 18), 2).otherwise(1))
    rows = rows.withColumn("p", F.slice("tokens", F.lit(1), n - o + F.col("k")))
    sets = """CASE k WHEN 1 THEN p
        WHEN 2 THEN flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> concat_ws(' ', x, y))))
        ELSE flatten(transform(p, (x, i) -> flatten(transform(slice(p, i + 2, size(p)), (y, j) -> transform(slice(p, i + j + 3, size(p)), z -> concat_ws(' ', x, y, z)))))) END"""
    return rows.select(*titles.columns, "m", "o", "k", F.explode(F.expr(sets)).alias("t"))


#: Cards of exactly one set of shingles up to which all their pairs are edges; beyond, each has an edge to the first.
MOST_COPIES = 32
#: Rows of one shingle that one task joins.
ROWS_A_TASK = 2_000


def duplicate_edges(cards: DataFrame, least: float = 0.8, width: int = 5, most_copies: int | None = MOST_COPIES) -> DataFrame:
    """(src, dst, confidence, retagged): cards of one author and year whose read texts overlap.

    Overlap is the share of the smaller set's distinct shingles.  Cards with equal sets are
    one class, which is compared once.  Two sets that overlap enough share one of the rarest
    ``(1 - least)`` of the smaller one's shingles, so only these are looked up, and rows of a
    frequent shingle are spread.  Of classes with more than ``most_copies`` cards each card
    has an edge to the class's first card, which alone has edges to other classes; None lists
    every pair.
    """
    key = F.struct(F.lower(F.trim("cite_author")).alias("author"), F.col("cite_year").alias("year"))
    base = cards.where("cite_author is not null and cite_year is not null").select("card_id", F.lower(F.trim("tag")).alias("tag"), F.xxhash64(key).alias("block"), F.split(T.normalize_title(F.col("read_text")), " ").alias("words"))
    base = stage(base.where(F.size("words") > 0).where(F.col("words")[0] != ""), "dup-words")
    # written out between the steps: otherwise the text is split again for every shingle
    sh = base.select("card_id", "tag", F.array_sort(F.array_distinct(F.transform(T.shingles(F.col("words"), width), lambda x: F.xxhash64("block", x)))).alias("s"))
    sh = stage(sh.withColumn("class", F.concat_ws("-", F.size("s").cast("string"), F.xxhash64("s").cast("string"), F.xxhash64(F.reverse("s")).cast("string"))), "dup-shingles")
    classes = stage(sh.groupBy("class").agg(F.min("card_id").alias("first"), F.count("*").alias("copies"), F.first("s").alias("s")).withColumn("n", F.size("s")), "dup-classes")
    each = classes.select("class", "n", F.explode("s").alias("h"))
    df = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rare = lookup_join(each, df, ["h"]).groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("t"))
    # shingles that occur once come first and can't be shared
    room = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("t"))
    prefix = rare.where(room > 0).select("class", "n", F.explode(F.slice("t", F.lit(1), room.cast("int"))).alias("x")).select("class", "n", "x.h")
    prefix = stage(prefix, "dup-prefix")
    salts = F.broadcast(prefix.groupBy("h").agg(F.ceil(F.count("*") / ROWS_A_TASK).cast("int").alias("salts")).where("salts > 1"))
    small = prefix.join(salts, "h", "left").select("h", F.col("class").alias("a"), "n", F.pmod(F.xxhash64("class"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    other = each.join(salts, "h", "left").select("h", F.col("class").alias("b"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    cand = stage(small.join(other, ["h", "salt"]).where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))).select("a", "b").distinct(), "dup-candidates")
    sets = classes.select("class", "s", "n")
    both = lookup_join(lookup_join(cand, sets.select(F.col("class").alias("a"), F.col("s").alias("sa"), "n"), ["a"]), sets.select(F.col("class").alias("b"), F.col("s").alias("sb")), ["b"])
    near = both.select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.col("n")).alias("c")).where(F.col("c") >= least)
    several = classes.where("copies > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("c"))
    listed = lookup_join(sh.select("card_id", "tag", "class"), classes.select("class", "first", "copies"), ["class"])
    listed = stage(listed.withColumn("all", F.lit(True) if most_copies is None else F.col("copies") <= most_copies), "dup-listed")
    own = listed.where(F.col("all") | (F.col("card_id") == F.col("first"))).select("card_id", "tag", "class")
    left = own.select(F.col("class").alias("a"), F.col("card_id").alias("x"), F.col("tag").alias("tx"))
    right = own.select(F.col("class").alias("b"), F.col("card_id").alias("y"), F.col("tag").alias("ty"))
    pairs = near.unionByName(several).join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select("x", "y", "tx", "ty", "c")
    first = listed.where(F.col("card_id") == F.col("first")).select("class", F.col("card_id").alias("x"), F.col("tag").alias("tx"))
    stars = lookup_join(listed.where(~F.col("all") & (F.col("card_id") != F.col("first"))), first, ["class"]).select("x", F.col("card_id").alias("y"), "tx", F.col("tag").alias("ty"), F.lit(1.0).alias("c"))
    out = pairs.unionByName(stars)
    return out.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), F.round("c", 3).alias("confidence"), (~F.col("tx").eqNullSafe(F.col("ty"))).alias("retagged"))


def duplicates_both_ways(edges: DataFrame) -> DataFrame:
    """(card_id, other): every duplicate of a card, whichever end it stands at."""
    d = edges.where("kind = 'duplicates' and src_node_id is not null and dst_node_id is not null and src_node_id <> dst_node_id")
    a = d.select(F.col("src_node_id").alias("card_id"), F.col("dst_node_id").alias("other"))
    return a.unionByName(d.select(F.col("dst_node_id").alias("card_id"), F.col("src_node_id").alias("other"))).distinct()


def edges_in_scope(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among ``ids`` (column id): two semi joins, so no join on an OR."""
    one = ids.select(F.col("id").alias("src_node_id")).distinct()
    two = ids.select(F.col("id").alias("dst_node_id")).distinct()
    return edges.join(one, "src_node_id", "left_semi").select(*edges.columns).unionByName(edges.join(two, "dst_node_id", "left_semi").select(*edges.columns)).distinct()


def outline(cards: DataFrame) -> DataFrame:
    """(source_id, path, title, parent, kind, card_count): the nodes that card paths imply; cards count at their own path only."""
    own = cards.where(F.size("path") > 0).groupBy("source_id", "path").agg(F.count("*").alias("n"))
    steps = own.select("source_id", "path", "n", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("d"))
    cut = steps.select("source_id", F.slice("path", F.lit(1), F.col("d")).alias("path"), F.when(F.col("d") == F.size("path"), F.col("n")).otherwise(0).alias("n"))
    nodes = cut.groupBy("source_id", "path").agg(F.sum("n").alias("card_count"))
    kind = F.when(F.size("path") == 1, "pocket").when(F.size("path") == 2, "hat").otherwise("block")
    return nodes.select("source_id", "path", F.element_at("path", -1).alias("title"), F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1)).alias("parent"), kind.alias("kind"), "card_count")


def tree_page(nodes: DataFrame, parent: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an outline level with the total and whether a node has children.

    A search looks at all titles with cards and ignores ``parent``.
    """
    if search:
        rows = nodes.where(F.lower("title").contains(search.lower()) & (F.col("card_count") > 0))
    else:
        rows = nodes.where(F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent)
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("card_count"), "title", "node_id").offset(offset).limit(limit)
    return page.join(parents, "node_id", "left").crossJoin(total).select("node_id", "title", "card_count", F.coalesce("has_children", F.lit(False)).alias("has_children"), "total")


def sections(paragraphs: DataFrame) -> DataFrame:
    """Cut paragraph rows (doc, ordinal, level, text) into cards.

    Level 1-3 are headings, level 4 is a card's tag, null is body text.  A heading ends
    deeper headings.  The first body paragraph of a card is its cite.  Returns (doc,
    card_no, tag, path, cite, body), and read_text and emphasis_text where paragraphs have
    them: those of the body, line by line.
    """
    marked = [c for c in ("read_text", "emphasis_text") if c in paragraphs.columns]
    w = W.partitionBy("doc").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    rows = paragraphs.withColumn("card_no", F.sum((F.coalesce("level", F.lit(0)) == 4).cast("int")).over(w))
    for k in (1, 2, 3):
        rows = rows.withColumn(f"at{k}", F.max(F.when(F.col("level") <= k, F.col("ordinal"))).over(w))
        rows = rows.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("ordinal", "text")), True).over(w))
    path = F.array_compact(F.array(*[F.when(F.col(f"h{k}.ordinal") >= F.col(f"at{k}"), F.col(f"h{k}.text")) for k in (1, 2, 3)]))
    rows = rows.withColumn("path", path).where("card_no > 0")
    last_heading = F.max(F.when(F.col("level") < 4, F.col("ordinal"))).over(w)
    tag_at = F.max(F.when(F.col("level") == 4, F.col("ordinal"))).over(w)
    inside = rows.withColumn("inside", F.coalesce(last_heading, F.lit(-1)) < tag_at).where("inside and (level is null or level = 4)")
    body = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("ordinal", "text", *marked))))
    cards = inside.groupBy("doc", "card_no").agg(F.max(F.when(F.col("level") == 4, F.col("text"))).alias("tag"), F.max(F.when(F.col("level") == 4, F.col("path"))).alias("path"), body.alias("b"))
    lines = F.transform("b", lambda x: x["text"])
    rest = F.slice("b", 2, 1_000_000)
    extra = [F.array_join(F.filter(rest.getField(c), lambda t: t != ""), "\n").alias(c) for c in marked]
    return cards.select("doc", "card_no", "tag", "path", F.try_element_at(lines, F.lit(1)).alias("cite"), F.array_join(F.slice(lines, 2, 1_000_000), "\n").alias("body"), *extra)
