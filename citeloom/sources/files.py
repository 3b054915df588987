"""Files on disk and in archives: scan, archives, dispatch by kind."""

from __future__ import annotations

import io
import subprocess
import zipfile
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of files that can be parsed, and the largest member and archive that is unpacked.
KINDS = ("docx", "docm", "htm", "html", "pdf", "txt")
MEMBER_BYTES, ARCHIVE_BYTES = 50 << 20, 500 << 20
RAW = "path string, source_id string, kind string, length bigint, content binary"


def suffix(c):
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, root: str, limit: int = 0, kinds=KINDS) -> DataFrame:
    """(path, source_id, kind, length, content) of parseable files below ``root``, in order of path.

    Lock files are skipped; ``limit`` 0 is none.  The id follows from path, length and time
    of change, so a changed file is another source.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*kinds, *[k.upper() for k in kinds]]) + "}").load(root)
    keep = ~F.col("path").rlike(r"/~\$[^/]*$")
    ident = F.substring(F.sha1(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))), 1, 12)
    rows = df.where(keep).select("path", ident.alias("source_id"), suffix(F.col("path")).alias("kind"), "length", "content")
    return rows.orderBy("path").limit(limit) if limit else rows


def git_files(spark: SparkSession, url: str, into: str, subdir: str = "") -> DataFrame:
    """Files of a git repository, cloned or brought up to date in the folder ``into`` that all tasks can read."""
    target = Path(into)
    if (target / ".git").exists():
        subprocess.run(["git", "-C", str(target), "pull", "--ff-only", "--quiet"], check=True, timeout=600)
    else:
        subprocess.run(["git", "clone", "--depth", "1", "--quiet", "--", url, str(target)], check=True, timeout=600)
    slug = "/".join(url.rstrip("/").removesuffix(".git").split("/")[-2:])
    return scan(spark, str(target / subdir)).withColumn("origin", F.lit(f"git:{slug}"))


def archive_members(archives: DataFrame, limit: int = 0, kinds=KINDS) -> DataFrame:
    """(path, source_id, kind, length, content) of the members of ZIP files (path, content).

    Members that would leave their folder, of unknown kind, or larger than
    ``MEMBER_BYTES`` are skipped, and of each archive no more is unpacked than
    ``ARCHIVE_BYTES`` in order of place.  Unreadable archives have no members.
    """

    def unpack(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                total = taken = 0
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, TypeError):
                    continue
                for info in z.infolist():
                    name = info.filename.replace("\\", "/")
                    parts = name.split("/")
                    if info.is_dir() or name.startswith("/") or ".." in parts or ":" in parts[0] or name.rpartition(".")[2].lower() not in kinds or info.file_size > MEMBER_BYTES:
                        continue
                    total += info.file_size
                    if total > ARCHIVE_BYTES or (limit and taken >= limit):
                        break
                    with z.open(info) as f:
                        data = f.read(MEMBER_BYTES + 1)
                    if len(data) > MEMBER_BYTES:  # the header lied
                        continue
                    taken += 1
                    rows.append((f"{path}!{name}", None, name.rpartition(".")[2].lower(), len(data), data))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "source_id", "kind", "length", "content"])

    out = archives.select("path", "content").mapInPandas(unpack, RAW)
    return out.withColumn("source_id", F.substring(F.sha1(F.concat_ws("|", "path", F.sha1("content"))), 1, 12))


def download_plan(urls: DataFrame, folder: str, limit: int = 0) -> DataFrame:
    """(url, target): where each URL is to be stored: a name that follows from the URL, each URL once."""
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1), r"[^A-Za-z0-9._-]", "_")
    plan = urls.where("url is not null").select("url").distinct().withColumn("target", F.concat(F.lit(folder.rstrip("/") + "/"), F.substring(F.sha1("url"), 1, 12), F.lit("-"), F.coalesce(F.nullif(name, F.lit("")), F.lit("file"))))
    return plan.orderBy("url").limit(limit) if limit else plan


def dispatch(files: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(parsed paragraphs, skipped files with a reason): each file goes to the parser of its kind; other kinds are skipped, not failed."""
    parsed = None
    for kind, parse in parsers.items():
        out = parse(files.where(F.col("kind") == kind))
        parsed = out if parsed is None else parsed.unionByName(out, allowMissingColumns=True)
    known = F.col("kind").isin(*parsers)
    skipped = files.where(~known | F.col("kind").isNull()).select("path", "source_id", F.concat(F.lit("unsupported: "), F.coalesce("kind", F.lit("?"))).alias("reason"))
    return parsed, skipped


def new_files(files: DataFrame, cards: DataFrame, force: bool = False) -> DataFrame:
    """Files whose source has no cards yet, or all of them."""
    return files if force else files.join(cards.select("source_id").distinct(), "source_id", "left_anti")


def page_cards(pages: DataFrame, least: int = 40) -> DataFrame:
    """(source_id, page, tag, cite_raw, body, read_text, disclosed_only): one card per extracted page of ``least`` characters.

    ``pages`` (source_id, page, text) holds text that was taken from PDF files; nothing in
    it tells what is read aloud.
    """
    t = F.trim("text")
    first = F.substring(F.regexp_extract(t, r"^([^\n]*)", 1), 1, 400)
    return pages.where(F.length(t) >= least).select("source_id", "page", first.alias("tag"), first.alias("cite_raw"), t.alias("body"), F.lit("").alias("read_text"), F.lit(True).alias("disclosed_only"))


def health(paragraphs: DataFrame) -> DataFrame:
    """(source_id, runs, marked, density, unmarked): how much of a file is marked; many runs and hardly a mark is a warning."""
    per = paragraphs.groupBy("source_id").agg(F.sum("runs").alias("runs"), F.sum("marked").alias("marked"))
    density = F.coalesce(F.col("marked") / F.nullif(F.col("runs"), F.lit(0)), F.lit(0.0))
    return per.select("source_id", "runs", "marked", F.round(density, 6).alias("density"), ((F.col("runs") >= 20) & (density < 0.02)).alias("unmarked"))


def fallback_cards(paragraphs: DataFrame) -> DataFrame:
    """(source_id, card_no, tag, cite, body) of files without headings: a cite line opens a card.

    The tag is the nearest of the three paragraphs before the cite that is no cite itself;
    the body runs to the next cite.
    """
    from citeloom.functions.text import looks_like_cite

    w = W.partitionBy("source_id").orderBy("ordinal")
    rows = paragraphs.where(F.trim("text") != "").withColumn("is_cite", looks_like_cite(F.col("text")))
    before = [F.when(~F.lag("is_cite", i).over(w), F.lag("text", i).over(w)) for i in (1, 2, 3)]
    rows = rows.withColumn("tag", F.coalesce(*before)).withColumn("card_no", F.sum(F.col("is_cite").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.where("card_no > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("is_cite"), F.struct("ordinal", "text"))))
    out = rows.groupBy("source_id", "card_no").agg(F.max(F.when(F.col("is_cite"), F.col("tag"))).alias("tag"), F.max(F.when(F.col("is_cite"), F.col("text"))).alias("cite"), body.alias("b"))
    return out.select("source_id", "card_no", "tag", "cite", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("body"))


# Named places from which files come: origin and how it is read.
ADAPTERS = {"local": scan, "git": git_files, "zip": archive_members}


def adapter(name: str):
    """The scan of a named adapter; ValueError for an unknown one."""
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter {name}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]
