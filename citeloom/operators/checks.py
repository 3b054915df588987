"""Findings about positions (outline nodes with cards) and about the corpus, and scores.

One join of nodes and cards and one grouped pass give every aggregate of a position; each
check is a projection of that wide row.  Findings have the columns kind, severity,
node_id, title, confidence, cards (how many); ``finding_cards`` lists the cards themselves
as rows, so that no position's cards are ever gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import text as T

# Weights of severities in the exposure, and their order.
EXPOSURE = {"critical": 1.0, "major": 0.45, "minor": 0.15, "info": 0.0}
SEVERITY_RANK = {"critical": 3, "major": 2, "minor": 1, "info": 0}
COLUMNS = ["kind", "severity", "node_id", "title", "confidence", "cards"]


#: Which cards a kind of finding is about, where it isn't all of a position.
FLAGGED = {
    "qualification_gap": "unqualified",
    "no_read_text": "not disclosed and unread",
    "thin_read": "not disclosed and not unread and rr > 0 and rr < 0.12",
    "power_tagging": "size(overclaims) > 0",
}


def clean_ratio(c="read_ratio"):
    """Null and NaN count as 0."""
    return F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))


def card_facts(cards: DataFrame, hedge: str = T.HEDGE, claim: str = T.STRONG_CLAIM) -> DataFrame:
    """Per card what the checks ask: flags, not texts.  ``hedge`` and ``claim``: the words that hedge and that claim much."""
    rr = clean_ratio()
    tag, body, read = (F.coalesce(c, F.lit("")) for c in ("tag", "body", "read_text"))
    hedge = "(?i)" + hedge
    disclosed = F.coalesce("disclosed_only", F.lit(False))
    unread = T.blank(F.col("read_text"))
    reasons = F.array_compact(
        F.array(
            F.when((read != "") & read.rlike(hedge) & ~tag.rlike(hedge), F.lit("read_hedges")),
            F.when(~disclosed & (rr > 0) & (rr < 0.15), F.lit("thin")),
            F.when(~disclosed & unread, F.lit("unread")),
            F.when(~disclosed & (body != "") & body.rlike(hedge) & (read != "") & ~read.rlike(hedge), F.lit("context_hedges")),
        )
    )
    return cards.select(
        "card_id", "source_id", "source_path", "path", "side", "cite_year",
        rr.alias("rr"), unread.alias("unread"), disclosed.alias("disclosed"),
        F.when(~T.blank(F.col("cite_author")), T.author_key(F.col("cite_author"))).alias("author"),
        (~F.coalesce("cite_raw", F.lit("")).rlike("(?i)" + T.QUALIFICATION) & T.blank(F.col("cite_pub"))).alias("unqualified"),
        F.when(tag.rlike("(?i)" + claim), reasons).otherwise(F.array().cast("array<string>")).alias("overclaims"),
    )


def template_sources(cards: DataFrame, sources: DataFrame, least: int = 3, share: float = 0.9) -> DataFrame:
    """(source_id, title, n, filled): sources of ``least`` cards or more, of which ``share`` have no body."""
    per = cards.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(~T.blank(F.col("body"))).alias("filled"))
    return per.join(sources.select("source_id", "title"), "source_id").where((F.col("n") >= least) & ((F.col("n") - F.col("filled")) / F.col("n") >= share)).select("source_id", "title", "n", "filled")


def scope_of(sources: DataFrame, owner: str | None) -> DataFrame | None:
    """Source ids whose path or title names the owner; None is no scope, no match an empty one."""
    if owner is None:
        return None
    hay = F.lower(F.concat_ws(" ", "path", "title"))
    return sources.where(hay.contains(owner.lower())).select("source_id")


def positions(nodes: DataFrame, scope: DataFrame | None = None, templates: DataFrame | None = None, least: int = 1) -> DataFrame:
    """Nodes with ``least`` cards or more that are no answer blocks, in scope and not of template sources."""
    rows = nodes.where((F.col("card_count") >= least) & (F.col("card_count") > 0) & T.answers_target(F.col("title")).isNull())
    if scope is not None:
        rows = rows.join(scope.select("source_id").distinct(), "source_id", "left_semi")
    if templates is not None:
        rows = rows.join(templates.select("source_id").distinct(), "source_id", "left_anti")
    return rows.select("node_id", "title", "source_id", "path")


def position_facts(places: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per position with every aggregate the checks need.  A card belongs to the node at its source and path.

    All are counts that combine before the shuffle, but for the distinct author keys.
    """
    at = places.join(facts, ["source_id", "path"])
    return at.groupBy("node_id", "title").agg(
        F.count("*").alias("n"),
        F.collect_set("author").alias("authors"),
        F.count_if(F.col("author").isNull()).alias("anonymous"),
        F.count_if(F.expr(FLAGGED["qualification_gap"])).alias("unqualified"),
        F.count_if(F.expr(FLAGGED["no_read_text"])).alias("unread"),
        F.count_if(F.expr(FLAGGED["thin_read"])).alias("thin"),
        F.count_if(~F.col("unread")).alias("read"),
        F.max("cite_year").alias("newest"),
        F.median(F.when(F.col("rr") > 0, F.col("rr"))).alias("median_ratio"),
    )


def _findings(rows: DataFrame, kind: str, severity, cards="n", confidence: float = 1.0) -> DataFrame:
    out = rows.withColumn("severity", severity).where(F.col("severity").isNotNull())
    return out.select(F.lit(kind).alias("kind"), "severity", "node_id", "title", F.lit(confidence).alias("confidence"), F.col(cards).cast("bigint").alias("cards"))


def finding_cards(findings: DataFrame, places: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, node_id, card_id): the cards that findings speak of."""
    at = places.select("node_id", "source_id", "path").join(facts, ["source_id", "path"])
    rows = findings.select("kind", "node_id").distinct().join(at, "node_id")
    hit = F.lit(True)
    for kind, cond in FLAGGED.items():
        hit &= (F.col("kind") != kind) | F.expr(cond)
    return rows.where(hit & ~F.col("kind").isin("answer_gap")).select("kind", "node_id", "card_id")


def _position_checks(concentrated: float = 0.4) -> dict:
    """kind: (severity or null, cards) as expressions on a row of ``position_facts`` (with ``corpus``, the newest year of all, for recency)."""
    n = F.col("n")
    d = F.size(T.group_author_keys("authors")) + F.col("anonymous")
    few = (d <= 2) & (n >= 4)
    share = F.col("unqualified") / n
    wide = (F.col("unqualified") > 0) & ((n == 1) | (share >= 0.75))
    lag = F.col("corpus") - F.col("newest")
    return {
        "source_concentration": (F.when((n >= 3) & (few | (d / n <= concentrated)), F.when(few, "major").otherwise("minor")), n),
        "single_card_contention": (F.when(n == 1, "major"), n),
        "qualification_gap": (F.when(wide, F.when(n <= 2, "major").otherwise("minor")).when(share >= 0.5, "minor"), F.col("unqualified")),
        "no_read_text": (F.when(F.col("unread") > 0, "major"), F.col("unread")),
        "thin_read": (F.when(F.col("thin") > 0, "minor"), F.col("thin")),
        "recency_decay": (F.when(lag >= 6, "major").when(lag >= 3, "minor"), n),
    }


def checked(p: DataFrame, facts: DataFrame, kinds: list[str] | None = None, concentrated: float = 0.4) -> DataFrame:
    """Findings of the checks that look at a position's aggregates: all of one row at once, so positions are read once.

    Few distinct authors, that is two or a share of ``concentrated`` (spellings one edit apart are one, each card without an author counts
    alone), a single card, no qualification and no publication, no or thin read text, and a
    newest card three years or more behind the corpus.
    """
    checks = _position_checks(concentrated)
    rows = p
    if kinds is None or "recency_decay" in kinds:
        rows = p.crossJoin(F.broadcast(facts.agg(F.max("cite_year").alias("corpus"))))  # one row
    found = [F.when(sev.isNotNull(), F.struct(F.lit(k).alias("kind"), sev.alias("severity"), c.cast("bigint").alias("cards"))) for k, (sev, c) in checks.items() if kinds is None or k in kinds]
    rows = rows.select("node_id", "title", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("f.kind", "f.severity", "node_id", "title", F.lit(1.0).alias("confidence"), "f.cards")


def power_tagging(places: DataFrame, facts: DataFrame) -> DataFrame:
    """One finding per card whose tag claims more than its read text gives (``finding_cards`` names it)."""
    hits = facts.where(F.size("overclaims") > 0).select("card_id", "source_id", "path", "overclaims", "unread")
    rows = places.join(hits, ["source_id", "path"])
    sev = F.when((F.size("overclaims") > 1) | F.col("unread"), "major").otherwise("minor")
    return _findings(rows.withColumn("n", F.lit(1)), "power_tagging", sev)


def answer_gap(places: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positions attacked by answer blocks that nothing answers; titles count once whatever their case."""
    answers = edges.where("kind = 'answers'").select(F.col("src_node_id").alias("attacker"), F.col("dst_node_id").alias("node_id")).distinct()
    answered = edges.where("kind = 'answers'").select(F.col("dst_node_id").alias("attacker")).distinct()
    open_ones = answers.join(answered, "attacker", "left_anti").join(nodes.select(F.col("node_id").alias("attacker"), F.lower("title").alias("name")).distinct(), "attacker")
    per = open_ones.groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = places.join(per, "node_id").withColumn("n", F.lit(0))
    return _findings(rows, "answer_gap", F.when(F.size("names") >= 2, "major").otherwise("minor"))


def unanswered_positions(places: DataFrame, p: DataFrame, edges: DataFrame) -> DataFrame:
    """Two cards or more and no answers edge into it; without any answers edge in the corpus nothing is found."""
    answers = edges.where("kind = 'answers' and dst_node_id is not null")
    any_edge = answers.limit(1).select(F.lit(1).alias("one"))
    rows = p.where("n >= 2").join(answers.select(F.col("dst_node_id").alias("node_id")).distinct(), "node_id", "left_anti").join(F.broadcast(any_edge))
    return _findings(rows, "unanswered_position", F.lit("info"))


def self_contradiction(facts: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(owner, author, aff, neg): an owner who reads one author on both sides."""
    rows = facts if scope is None else facts.join(scope.select("source_id").distinct(), "source_id", "left_semi")
    rows = rows.where("author is not null and author <> ''").withColumn("owner", T.owner_of(F.col("source_path"), F.col("source_id")))
    per = rows.where("owner is not null").groupBy("owner", "author").agg(F.count_if(F.col("side") == "aff").alias("aff"), F.count_if(F.col("side") == "neg").alias("neg"))
    return per.where("aff > 0 and neg > 0")


def duplicate_bloat(duplicates: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(edges, retagged) if three duplicate edges or more lie in scope and two of them are retagged; else no row."""
    from citeloom.operators.graph import edges_in_scope

    rows = duplicates if ids is None else edges_in_scope(duplicates, ids)
    per = rows.agg(F.count("*").alias("edges"), F.count_if(F.col("retagged")).alias("retagged"))
    return per.where("edges >= 3 and retagged >= 2")


def first_findings(findings: DataFrame) -> DataFrame:
    """Of findings about the corpus with the same kind and title, the first by severity, confidence and node."""
    order = [F.desc(severity_rank()), F.desc("confidence"), "node_id"]
    return findings.withColumn("_k", F.row_number().over(W.partitionBy("kind", "title").orderBy(*order))).where("_k = 1").drop("_k")


def severity_rank(c="severity"):
    return reduce(lambda e, kv: e.when(F.col(c) == kv[0], kv[1]), SEVERITY_RANK.items(), F.when(F.lit(False), 0))


def position_findings(places: DataFrame, p: DataFrame, facts: DataFrame) -> DataFrame:
    """All findings about positions, which are what scores count; each position keeps its own, and each card its overclaim."""
    return checked(p, facts).unionByName(power_tagging(places, facts))


def corpus_findings(places: DataFrame, p: DataFrame, facts: DataFrame, edges: DataFrame, nodes: DataFrame, templates: DataFrame, duplicates: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Findings about the corpus, one per kind and title: unfilled sources, open attacks, unanswered positions, authors on both sides, recut cards.

    ``duplicates``: edges (src, dst, retagged).  Those about no position have a null node_id.
    """
    whole = [F.lit(None).cast("string").alias("node_id")]
    empty = templates.agg(F.count("*").alias("k"), F.sum("n").alias("cards")).where("k > 0")
    empty = empty.select(F.lit("no_read_text").alias("kind"), F.lit("info").alias("severity"), *whole, F.concat(F.col("k").cast("string"), F.lit(" unfilled sources")).alias("title"), F.lit(1.0).alias("confidence"), "cards")
    sides = self_contradiction(facts, scope)
    sides = sides.select(F.lit("self_contradiction").alias("kind"), F.lit("major").alias("severity"), *whole, F.concat_ws(": ", "owner", "author").alias("title"), F.lit(1.0).alias("confidence"), (F.col("aff") + F.col("neg")).alias("cards"))
    bloat = duplicate_bloat(duplicates)
    bloat = bloat.select(F.lit("duplicate_bloat").alias("kind"), F.lit("minor").alias("severity"), *whole, F.concat(F.col("retagged").cast("string"), F.lit(" pairs under other tags")).alias("title"), F.lit(1.0).alias("confidence"), F.col("edges").alias("cards"))
    parts = [answer_gap(places, edges, nodes), unanswered_positions(places, p, edges), empty, sides, bloat]
    return first_findings(reduce(lambda a, b: a.unionByName(b), parts))


def scores(p: DataFrame, findings: DataFrame) -> DataFrame:
    """(node_id, n, support, exposure, priority), each within 0 and 1."""
    d = F.size(T.group_author_keys("authors")) + F.col("anonymous")
    depth = F.when(F.col("median_ratio").isNull() | F.col("median_ratio").between(0.15, 0.9), 1.0).otherwise(0.6)
    support = 0.35 * F.least(F.col("n") / 5, F.lit(1.0)) + 0.30 * F.least(d / F.greatest(F.least(F.col("n"), F.lit(4)), F.lit(1)), F.lit(1.0)) + 0.25 * F.col("read") / F.col("n") + 0.10 * depth
    weight = reduce(lambda e, kv: e.when(F.col("severity") == kv[0], kv[1]), EXPOSURE.items(), F.when(F.lit(False), 0.0))
    raw = findings.groupBy("node_id").agg(F.sum(weight * F.col("confidence")).alias("raw"))
    exposed = 1 - 1 / (1 + F.coalesce("raw", F.lit(0.0)))
    rows = p.join(raw, "node_id", "left").withColumn("e", exposed)
    priority = 0.65 * F.col("e") + 0.35 * F.least(F.col("n") / 6, F.lit(1.0))
    return rows.select("node_id", "title", "n", F.round(support, 3).alias("support"), F.round("e", 3).alias("exposure"), F.round(priority, 3).alias("priority"))


def capped(findings: DataFrame, by: str = "kind", most: int = 5) -> DataFrame:
    """The first ``most`` findings of each ``by``, with how many were left out."""
    order = [F.desc(severity_rank()), F.desc("confidence"), "title", "node_id"]
    total = findings.groupBy(by).agg(F.count("*").alias("total"))
    first = findings.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= most)
    return first.join(total, by).withColumn("hidden", F.greatest(F.col("total") - most, F.lit(0)))


def ground(findings: DataFrame, cards: DataFrame) -> DataFrame:
    """Findings of a model (finding_id, severity, confidence, labels, quotes, shown) against the cards they cite.

    ``shown`` lists the card ids a prompt offered; labels such as C3 or [3] count in it from
    1, and ids may be given themselves.  Without a valid card a finding is ungrounded: its
    confidence is at most 0.3 and it is minor at most.  A quotation that doesn't stand in
    the cards is dropped, and confidence is at most 0.6 then.
    """
    labels = findings.select("finding_id", "shown", F.posexplode_outer("labels").alias("pos", "label"))
    at = T.label_index(F.col("label"))
    picked = F.coalesce(F.when((at >= 1) & (at <= F.size("shown")), F.try_element_at("shown", at)), F.when(F.array_contains("shown", F.trim("label")), F.trim("label")))
    resolved = labels.select("finding_id", "pos", picked.alias("card_id")).where("card_id is not null").groupBy("finding_id", "card_id").agg(F.min("pos").alias("pos"))
    texts = cards.select("card_id", F.concat_ws(" ", "tag", "read_text", "body", "cite_raw").alias("text"))
    held = resolved.join(texts, "card_id").groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "card_id"))).alias("c"), F.concat_ws(" ", F.collect_list("text")).alias("text"))
    rows = findings.join(held, "finding_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    quotes = F.coalesce("quotes", F.array().cast("array<string>"))
    kept = F.filter(quotes, lambda q: T.quote_holds(q, F.col("text")))
    rows = rows.withColumn("kept", kept).withColumn("card_ids", F.coalesce(F.transform("c", lambda x: x["card_id"]), F.array().cast("array<string>"))).withColumn("grounded", F.size("card_ids") > 0)
    dropped = F.size("kept") < F.size(quotes)
    sure = F.least(F.col("confidence"), F.when(~F.col("grounded"), 0.3).when(dropped, 0.6).otherwise(1.0))
    sev = F.when(~F.col("grounded") & F.col("severity").isin("critical", "major"), "minor").otherwise(F.col("severity"))
    return rows.select("finding_id", sev.alias("severity"), sure.alias("confidence"), "card_ids", F.col("kept").alias("quotes"), "grounded")


def chain_findings(steps: DataFrame) -> DataFrame:
    """Findings of argument chains (position, step, status): a missing link breaks it, a weak one mismatches.

    The first and last link of a chain are less severe when missing.
    """
    w = W.partitionBy("position")
    end = (F.col("step") == 1) | (F.col("step") == F.count("*").over(w))
    rows = steps.withColumn("end", end).where("status in ('missing', 'weak')")
    missing = F.col("status") == "missing"
    return rows.select(
        "position", "step", F.when(missing, "chain_break").otherwise("warrant_mismatch").alias("kind"), F.when(missing & ~F.col("end"), "critical").otherwise("major").alias("severity"), F.when(missing, 0.75).otherwise(0.65).alias("confidence")
    )


def distinct_proposals(proposals: DataFrame, least: float = 0.6) -> DataFrame:
    """Proposals (position, priority, title) without those like an earlier one: a fold in order of priority."""
    words = T.content_tokens(T.normalize_title(F.col("title")))
    rows = proposals.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("priority", "title", words.alias("w")))).alias("p"))
    fold = F.aggregate("p", F.slice("p", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: T.jaccard(x["w"], y["w"]) >= least), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("position", F.explode(fold).alias("x")).select("position", "x.priority", "x.title")


def proposal_coverage(proposals: DataFrame, matches: DataFrame, pool: DataFrame, have: float = 0.60, least_pool: int = 200) -> DataFrame:
    """(proposal_id, score, state): none without a match; have from ``have`` on in a pool of enough cards; else partial."""
    n = pool.agg(F.count("*").alias("pool"))
    best = matches.groupBy("proposal_id").agg(F.max("score").alias("score"))
    rows = proposals.select("proposal_id").distinct().join(best, "proposal_id", "left").crossJoin(F.broadcast(n))  # one row
    return rows.select("proposal_id", "score", F.when(F.col("score").isNull(), "none").when((F.col("score") >= have) & (F.col("pool") >= least_pool), "have").otherwise("partial").alias("state"))
