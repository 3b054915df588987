"""The best representative of each group of duplicates.

Rival source lines are compared by token-level consensus.  A line is cut into typed
tokens (author, year, qualification, publication, title, URL); the lines of a group are
aligned progressively, component by component; the weighted tokens of a column vote, and
silence has no vote, so the consensus states whatever any line states.  Then every line is
read again with the consensus: what the group's votes show to be its publication or its
author's qualification counts wherever it stands.  The line closest to the consensus, that
is the one that misses the fewest of its components, is emitted.
Large groups are aligned in chunks whose profiles are then aligned with each other.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty
from citeloom.llm.names import NOBODY, TITLES, fold, parse
from citeloom.skew import lookup_join
from citeloom.staging import drop_staged, stage

COMPONENTS = ("author", "year", "qualification", "publication", "title", "url")
#: Distinct lines aligned in one chunk, and profiles aligned with each other at once.
CHUNK = 64
#: Words that name what somebody is (fixed values; English).
ROLES = frozenset(
    "advisor adviser analyst anthropologist assistant associate attorney candidate chair chairman chief columnist commissioner consultant coordinator correspondent counsel dean deputy diplomat director doctor economist editor engineer executive expert fellow founder geographer historian instructor journalist judge lawyer lecturer manager minister officer phd philosopher physician president principal professor reporter researcher scholar scientist secretary senator sociologist specialist spokesman spokesperson strategist student teacher writer".split()
)
_URL = re.compile(r"https?://[^\s\])}~>;,]+|www\.[^\s\])}~>;,]+")
_QUOTED = re.compile(r"[\"“]([^\"“”]{3,})[\"”]")
_DETAILS = re.compile(r"[(\[~\"“{]|--|—|https?://|;")
_YEAR = re.compile(r"(?<![\w/.,])['’]?(\d{4}|\d{2})(?![\w/])")
_REMARK = re.compile(r"(?<!:)//\s*\w{1,4}\b|\*[^*]*\*|\s-\s+[a-z][^()\[\]]*$|[(\[](?:accessed|emphasis|recut|bracket|cite omitted)[^()\[\]]*[)\]]", re.I)
_SPLIT = re.compile(r"[;,()\[\]~{}]|\.\s|\.$|--|—")
_DATE = re.compile(r"^\d{1,2}/\d{1,2}/\d{2,4}$")
_TOKEN = re.compile(r"\w+")
_SMALL = frozenset("of the and in on for to at by a an & de la".split())


def _is_title_case(words: list[str]) -> bool:
    big = [w for w in words if w.lower() not in _SMALL]
    return bool(big) and all(w[0].isupper() for w in big)


def state(line: str | None) -> dict[str, str]:
    """What a source line states: component and its text.  Remarks and placeholders state none."""
    out: dict[str, str] = {}
    if not line or not line.strip():
        return out
    rest = _REMARK.sub(" ", line)
    url = _URL.search(rest)
    if url:
        out["url"] = url[0].rstrip(".")
        rest = _URL.sub(" ; ", rest)
    title = _QUOTED.search(rest)
    first = _DETAILS.search(rest)
    head = rest[: first.start()] if first else rest
    if title:
        out["title"] = title[1].strip()
        rest = _QUOTED.sub(" ; ", rest)
    year = _YEAR.search(head)
    name = head[: year.start()] if year else head
    words = re.findall(r"[^\W\d_]+", name)
    low = [fold(w) for w in words]
    placeholder = "cite" in low or "cites" in low
    named = [w for w, f in zip(words, low) if w[0].isupper() and len(f) > 1 and f not in TITLES and f not in NOBODY]
    like_name = named and sum(w[0].islower() for w in words) <= max(1, len(named)) and (len(low[0]) == 1 or low[0] not in NOBODY - {"the"})
    if not placeholder and (like_name or parse(name.strip(" ,"))):
        out["author"] = " ".join(name.split())
    if year and not placeholder:
        out["year"] = year[1]
    body = rest[len(head) :] if rest.startswith(head) else rest
    for part in _SPLIT.split(body):
        words = part.split()
        if not words or _DATE.match(part.strip()) or not any(c.isalpha() for c in part):
            continue
        roles = {w.strip(".").lower() for w in words} & ROLES
        if roles and "qualification" not in out and len(words) <= 12:
            out["qualification"] = " ".join(words)
        elif not roles and "publication" not in out and _is_title_case(words) and len(words) <= 10 and "cite" not in part.lower():
            out["publication"] = " ".join(words)
    return out


def tokens(line: str | None) -> dict[str, list[str]]:
    """Typed tokens of a line, by component."""
    return {c: ([v] if c in ("url", "year") else _TOKEN.findall(v) or [v]) for c, v in state(line).items()}


def align(columns: list[dict], added: list[dict]) -> list[dict]:
    """Merge two lists of columns (token to weight) of one component along their best alignment."""
    n, m = len(columns), len(added)
    if n == m and all(a.keys() & b.keys() for a, b in zip(columns, added)):
        steps = [(i, i) for i in range(n)]
    else:
        score = [[-0.5 * (i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            a, weight = columns[i - 1], sum(columns[i - 1].values())
            for j in range(1, m + 1):
                same = sum(a.get(t, 0.0) for t in added[j - 1]) / weight
                score[i][j] = max(score[i - 1][j - 1] + (2.0 * same - 0.6), score[i - 1][j] - 0.5, score[i][j - 1] - 0.5)
        steps, i, j = [], n, m
        while i or j:
            if i and j:
                a = columns[i - 1]
                same = sum(a.get(t, 0.0) for t in added[j - 1]) / sum(a.values())
                if abs(score[i][j] - (score[i - 1][j - 1] + (2.0 * same - 0.6))) < 1e-9:
                    i, j = i - 1, j - 1
                    steps.append((i, j))
                    continue
            if i and (not j or abs(score[i][j] - (score[i - 1][j] - 0.5)) < 1e-9):
                i -= 1
                steps.append((i, None))
            else:
                j -= 1
                steps.append((None, j))
        steps.reverse()
    out = []
    for i, j in steps:
        col = dict(columns[i]) if i is not None else {}
        for t, w in (added[j] if j is not None else {}).items():
            col[t] = col.get(t, 0.0) + w
        out.append(col)
    return out


def merge_profiles(a: dict, b: dict) -> dict:
    """Component by component, so that a column never mixes components."""
    return {c: align(a[c], b[c]) if c in a and c in b else a.get(c) or b[c] for c in {**a, **b}}


def consensus_of(profile: dict) -> dict[str, list[str]]:
    """The token with most votes of every column (the smaller of equal ones)."""
    return {c: [min(col, key=lambda t: (-col[t], t)) for col in cols] for c, cols in profile.items()}


#: Components whose wording alone tells them; share of the consensus' main tokens that a line must have to state one.
WORDED, AGREEMENT = ("qualification", "publication"), 0.75


def core_of(profile: dict) -> dict[str, list[str]]:
    """Per component the winning tokens of the columns with at least half the votes of its strongest column."""
    out = {}
    for c, cols in profile.items():
        most = [max(col.values()) for col in cols]
        out[c] = [min(col, key=lambda t: (-col[t], t)) for col, m in zip(cols, most) if 2 * m >= max(most)]
    return out


def stated_with(line: str | None, core: dict) -> set[str]:
    """The components that a line states, read with its group's consensus.

    Those its own grammar tells, and the worded ones whose voted tokens stand in the rest
    of the line: what other lines of the group show to be a publication is one here too.
    """
    own = tokens(line)
    out = set(own)
    rest = None
    for c in WORDED:
        voted = [t.lower() for t in core.get(c, ())]
        if c in own or len(voted) < 2:
            continue
        if rest is None:
            rest = Counter(t.lower() for t in _TOKEN.findall(_URL.sub(" ", _REMARK.sub(" ", line or ""))))
            rest.subtract(t.lower() for v in own.values() for t in v)
        if sum(rest[t] > 0 for t in voted) >= AGREEMENT * len(voted):
            out.add(c)
    return out


@nonempty
def _fold_runs(batches, parse: bool):
    """One profile per run of equal (group_id, chunk) in sorted rows, however many batches a run spans."""
    at, profile, done = None, {}, []
    for pdf in batches:
        for g, k, text, weight in zip(pdf["group_id"], pdf["chunk"], pdf["text"], pdf["weight"]):
            if (g, k) != at:
                if at is not None:
                    done.append((*at, json.dumps(profile)))
                at, profile = (g, k), {}
            new = {c: [{t: float(weight)} for t in v] for c, v in tokens(text).items()} if parse else json.loads(text)
            profile = merge_profiles(profile, new) if profile else new
        yield pd.DataFrame(done, columns=["group_id", "chunk", "profile"])
        done = []
    if at is not None:
        yield pd.DataFrame([(*at, json.dumps(profile))], columns=["group_id", "chunk", "profile"])


def group_profiles(values: DataFrame) -> DataFrame:
    """(group_id, profile) for values (group_id, text, weight), aligned chunk by chunk."""
    sizes = values.groupBy("group_id").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    rows = lookup_join(values, sizes, ["group_id"]).withColumn("chunk", F.pmod(F.xxhash64("text"), F.col("chunks")))
    parse = True
    held = None
    while True:
        order = rows.repartition("group_id", "chunk").sortWithinPartitions("group_id", "chunk", F.desc("weight"), F.desc(F.length("text")), "text")
        out = stage(order.select("group_id", "chunk", "text", "weight").mapInPandas(lambda b, p=parse: _fold_runs(b, p), "group_id string, chunk long, profile string"), "profiles")
        drop_staged(held)
        if (out.agg(F.max("chunk")).first()[0] or 0) == 0:
            return out.select("group_id", "profile")
        held, parse = out, False
        rows = out.select("group_id", F.floor(F.col("chunk") / CHUNK).alias("chunk"), F.col("profile").alias("text"), F.lit(1.0).alias("weight"))


def closest_to_consensus(records: DataFrame, group: str, key: str, line: str) -> DataFrame:
    """(group_id, key, missing, consensus) per group: the record whose line is closest to the group's consensus.

    Equal ones: the smaller key.  Null and empty lines state nothing and still compete;
    repeated records count once.  Rows with a null group or key are left out.
    """
    rows = records.select(F.col(group).alias("group_id"), F.col(key).alias("key"), F.coalesce(line, F.lit("")).alias("text")).where("group_id is not null and key is not null").distinct()
    # equal lines of a group are one value; of its records only the smallest key can win
    values = stage(rows.groupBy("group_id", "text").agg(F.count("*").cast("double").alias("weight"), F.min("key").alias("key")), "values")
    profiles = group_profiles(values.select("group_id", "text", "weight"))

    @nonempty
    def settle(batches):
        for pdf in batches:
            made = [json.loads(p) for p in pdf["profile"]]
            text = [json.dumps([core_of(p), "; ".join(" ".join(v) for v in (consensus_of(p).get(c) for c in COMPONENTS) if v)]) for p in made]
            yield pd.DataFrame({"group_id": pdf["group_id"], "consensus": text})

    # the lines get the consensus, whose length is that of a line, and not the votes
    settled = stage(profiles.mapInPandas(settle, "group_id string, consensus string"), "consensus")

    @nonempty
    def judge(batches):
        known = (None, None)
        for pdf in batches:
            out = []
            for g, k, text, held in zip(pdf["group_id"], pdf["key"], pdf["text"], pdf["consensus"]):
                if known[0] != held:
                    known = (held, json.loads(held))
                core, whole = known[1]
                out.append((g, k, len(core) - len(stated_with(text, core)), whole))
            yield pd.DataFrame(out, columns=["group_id", "key", "missing", "consensus"])

    judged = lookup_join(values, settled, ["group_id"]).select("group_id", "key", "text", "consensus").mapInPandas(judge, "group_id string, key string, missing int, consensus string")
    best = judged.groupBy("group_id").agg(F.min(F.struct("missing", "key", "consensus")).alias("b"))
    return best.select("group_id", F.col("b.key").alias("key"), F.col("b.missing").alias("missing"), F.col("b.consensus").alias("consensus"))


def trusted_record(records: DataFrame, group: str, key: str, disclosed: str, ratio: str, low: float = 0.12, high: float = 0.92) -> DataFrame:
    """(group_id, key): not only disclosed before anything else, then a ratio within bounds, the higher one, the smaller key.

    Null and NaN ratios lie outside the bounds; outside them ratios don't count.
    """
    inside = F.coalesce((F.col(ratio) >= low) & (F.col(ratio) <= high) & ~F.isnan(ratio), F.lit(False))
    rank = F.struct(
        F.when(F.col(disclosed) == F.lit(False), 0).otherwise(1).alias("d"),
        F.when(inside, 0).otherwise(1).alias("r"),
        F.when(inside, -F.col(ratio)).otherwise(F.lit(0.0)).alias("n"),
        F.col(key).alias("key"),
    )
    return records.where(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.min(rank).alias("b")).select("group_id", F.col("b.key").alias("key"))


def best_records(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, card_id, cite_card_id, consensus) for groups (node_id, group_id) with two cards or more."""
    own = cards.select("card_id", "read_ratio", "cite_raw", "disclosed_only").where("card_id is not null")
    members = own.join(groups.select(F.col("node_id").alias("card_id"), "group_id"), "card_id").distinct()
    members = stage(members, "members")
    enough = members.groupBy("group_id").agg(F.min("card_id").alias("lo"), F.max("card_id").alias("hi")).where("lo <> hi").select("group_id")
    members = lookup_join(members, enough, ["group_id"])
    best = trusted_record(members, "group_id", "card_id", "disclosed_only", "read_ratio").withColumnRenamed("key", "card_id")
    cite = closest_to_consensus(members, "group_id", "card_id", "cite_raw").withColumnRenamed("key", "cite_card_id")
    return best.join(cite, "group_id").select("group_id", "card_id", "cite_card_id", "consensus")
