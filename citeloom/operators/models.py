"""Model-backed steps: prompts from cards, answers as findings.

A provider is any object with ``complete(prompt) -> str``.  Calls are few (positions that a
person asked about) and made on the driver; everything before and after is a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cards shown for chains and critiques, for proposals, and characters of read text shown.
CHAIN_CARDS, PROPOSAL_CARDS, SHOWN = 24, 18, 900
MOST_CALLS = 200


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


class Scripted:
    """Answers from a list or a function, for tests and replays."""

    def __init__(self, answers):
        self.answers, self.prompts = answers, []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.answers(prompt) if callable(self.answers) else self.answers[len(self.prompts) - 1]


class Cached:
    """Remembers answers in files named by the prompt's hash; a damaged file is asked for again."""

    def __init__(self, inner: Provider, folder: str):
        self.inner, self.folder, self.hits, self.calls = inner, Path(folder), 0, 0
        self.folder.mkdir(parents=True, exist_ok=True)

    def complete(self, prompt: str) -> str:
        path = self.folder / (hashlib.sha256(prompt.encode()).hexdigest() + ".json")
        try:
            answer = json.loads(path.read_text())["answer"]
            self.hits += 1
            return answer
        except (OSError, ValueError, KeyError, TypeError):
            self.calls += 1
            answer = self.inner.complete(prompt)
            temp = path.with_suffix(".part")
            temp.write_text(json.dumps({"prompt": prompt, "answer": answer}))
            temp.replace(path)
            return answer


def presented(cards: DataFrame, most: int = CHAIN_CARDS, shown: int = SHOWN) -> DataFrame:
    """(node_id, shown, text): the first ``most`` cards of each position (node_id, card_id, ordinal, ...) as labelled text, and their ids in order."""
    k = F.row_number().over(W.partitionBy("node_id").orderBy("ordinal", "card_id"))
    rows = cards.withColumn("k", k).where(F.col("k") <= most)
    line = F.concat(F.lit("[C"), F.col("k").cast("string"), F.lit("] "), F.coalesce("tag", F.lit("")), F.lit("\nCite: "), F.coalesce("cite_raw", F.lit("")), F.lit("\nRead: "), F.substring(F.coalesce(F.nullif("read_text", F.lit("")), "body", F.lit("")), 1, shown))
    per = rows.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("k", "card_id", line.alias("line")))).alias("x"))
    return per.select("node_id", F.transform("x", lambda x: x["card_id"]).alias("shown"), F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("text"))


def extract_json(text: str):
    """The JSON value in an answer: whole, fenced, widest braces, or that without trailing commas; None otherwise."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    wide = re.search(r"\{.*\}|\[.*\]", text, re.S)
    tries = [text, fenced[1] if fenced else "", wide[0] if wide else ""]
    for t in [*tries, *(re.sub(r",\s*([}\]])", r"\1", t) for t in tries)]:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def salvage(value, array: str, required: tuple[str, ...]) -> tuple[list[dict], int]:
    """The usable rows of one array of an answer, and how many were not."""
    rows = value.get(array) if isinstance(value, dict) else value
    if not isinstance(rows, list):
        return [], 0
    good = [r for r in rows if isinstance(r, dict) and all(isinstance(r.get(k), str) and r[k].strip() for k in required)]
    return good, len(rows) - len(good)


def ask(provider: Provider, prompt: str, usable: Callable[[object], bool], tries: int = 2):
    """The JSON of an answer; a wrong one is asked for again with what was wrong."""
    note = ""
    for _ in range(tries):
        value = extract_json(provider.complete(prompt + note))
        if value is not None and usable(value):
            return value
        note = "\n\nYour last answer could not be used. Answer with one JSON value of the stated shape only."
    return None


def _asked(prompts: DataFrame) -> list:
    """The prompts, or an error where there are more than a person would ask about: none is dropped."""
    asked = prompts.orderBy("node_id").limit(MOST_CALLS + 1).collect()
    if len(asked) > MOST_CALLS:
        raise ValueError(f"no more than {MOST_CALLS} positions are asked about at once")
    return asked


def critique(spark: SparkSession, prompts: DataFrame, provider: Provider, kinds: set[str], instruction: str) -> DataFrame:
    """Findings (finding_id, node_id, kind, severity, title, confidence, labels, quotes, shown) that a model reports; unknown kinds are left out.

    Feed the result to ``checks.ground``.
    """
    rows = []
    for p in _asked(prompts):
        value = ask(provider, f"{instruction}\n\n{p['text']}", lambda v: isinstance(v, dict) and isinstance(v.get("findings"), list))
        found, _ = salvage(value, "findings", ("kind", "title"))
        for i, f in enumerate(x for x in found if x["kind"] in kinds):
            strings = {k: [s for s in f.get(k) or [] if isinstance(s, str)] if isinstance(f.get(k), list) else [] for k in ("labels", "quotes")}
            sure = f.get("confidence")
            rows.append((f"{p['node_id']}#{i}", p["node_id"], f["kind"], f.get("severity") if f.get("severity") in ("critical", "major", "minor", "info") else "minor", f["title"], float(sure) if isinstance(sure, (int, float)) and 0 <= sure <= 1 else 0.5, strings["labels"], strings["quotes"], list(p["shown"])))
    return spark.createDataFrame(rows, "finding_id string, node_id string, kind string, severity string, title string, confidence double, labels array<string>, quotes array<string>, shown array<string>")


def chains(spark: SparkSession, prompts: DataFrame, provider: Provider, instruction: str) -> DataFrame:
    """Steps (position, step, claim, status) of argument chains; a supported step without a label that was shown is missing."""
    rows = []
    for p in _asked(prompts):
        value = ask(provider, f"{instruction}\n\n{p['text']}", lambda v: isinstance(v, dict) and isinstance(v.get("chain"), list))
        steps, _ = salvage(value, "chain", ("claim", "status"))
        for i, s in enumerate(steps, 1):
            labels = [x for x in s.get("labels") or [] if isinstance(x, str)]
            valid = [x for x in labels if (m := re.fullmatch(r"\[?[Cc]?(\d+)\]?", x.strip())) and 1 <= int(m[1]) <= len(p["shown"]) or x in p["shown"]]
            status = s["status"] if s["status"] in ("supported", "weak", "missing") else "missing"
            rows.append((p["node_id"], i, s["claim"], "missing" if status == "supported" and not valid else status))
    return spark.createDataFrame(rows, "position string, step int, claim string, status string")
