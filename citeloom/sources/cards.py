"""From files to cards: the paragraphs of styled documents and wiki pages, cut into cards with what is read aloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import graph
from citeloom.sources import documents, files
from citeloom.staging import stage

#: Kinds of files that become cards here; PDF text comes through ``files.page_cards``.
STYLED, PAGES = ("docx", "docm"), ("htm", "html")
FAILED = "!failed"


def cards_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, left out): cards of files (path, source_id, kind, content), and the files that gave none, with the reason.

    Documents with headings are cut at these, others at their cite lines.  Of an archived
    wiki page all that is disclosed counts as read.  Unreadable files, pages that are no
    wiki's and other kinds are left out.  No file at all gives two empty tables.
    """
    wiki = found.where(F.col("kind").isin(*PAGES) & documents.is_wiki_page(F.col("content")))
    styled = found.where(F.col("kind").isin(*STYLED))
    rows = documents.read_docx(styled).withColumn("wiki", F.lit(False)).unionByName(documents.read_wiki(wiki).withColumn("wiki", F.lit(True)))
    paragraphs = stage(rows, "paragraphs")  # read several times below
    whole = paragraphs.where(F.coalesce("style", F.lit("")) != FAILED)
    headed = whole.where("level = 4").select("source_id").distinct()
    cut = graph.sections(whole.join(headed, "source_id", "left_semi").withColumnRenamed("source_id", "doc"))
    cut = cut.select(F.col("doc").alias("source_id"), "card_no", "tag", "path", F.col("cite").alias("cite_raw"), "body", "read_text", "emphasis_text")
    plain = files.fallback_cards(whole.join(headed, "source_id", "left_anti"))
    plain = plain.select("source_id", "card_no", "tag", F.array().cast("array<string>").alias("path"), F.col("cite").alias("cite_raw"), "body", F.lit("").alias("read_text"), F.lit("").alias("emphasis_text"))
    pages = whole.where("wiki").select("source_id").distinct().withColumn("wiki", F.lit(True))
    places = found.select("source_id", F.col("path").alias("source_path"))
    cards = cut.unionByName(plain).join(pages, "source_id", "left").withColumn("wiki", F.coalesce("wiki", F.lit(False))).join(places, "source_id")
    cards = _disclosed(cards)
    cite = T.parse_cite(F.col("cite_raw"))
    out = cards.withColumn("_c", cite).select(
        F.substring(F.sha1(F.concat_ws("|", "source_id", F.col("card_no").cast("string"), "tag")), 1, 16).alias("card_id"), "tag", "cite_raw",
        F.when(T.plausible_author(F.col("_c.author")), F.col("_c.author")).alias("cite_author"), F.col("_c.year").alias("cite_year"), F.col("_c.publication").alias("cite_pub"), F.col("_c.url").alias("cite_url"),
        "body", "read_text", "emphasis_text", F.round(F.length("read_text") / F.nullif(F.length("body"), F.lit(0)), 4).alias("read_ratio"), T.infer_side(F.array_join("path", " / "), F.col("tag")).alias("side"),
        "path", F.try_element_at("path", F.lit(-1)).alias("block"), F.try_element_at("path", F.lit(1)).alias("pocket"), "source_id", "source_path", F.col("card_no").alias("ordinal"), F.col("wiki").alias("disclosed_only"),
    )
    failed = paragraphs.where(F.col("style") == FAILED).select("source_id", F.lit("unreadable").alias("reason"))
    other = found.join(paragraphs.select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.when(F.col("kind").isin(*STYLED), "no text").when(F.col("kind").isin(*PAGES), "no wiki page").otherwise(F.concat(F.lit("unsupported: "), F.coalesce("kind", F.lit("?")))).alias("reason"))
    return out, failed.unionByName(other).join(places, "source_id").select("source_path", "source_id", "reason")


def _disclosed(cards: DataFrame) -> DataFrame:
    """Cards of wiki pages: their first line is the cite, and what follows is both the body and read."""
    lines = F.filter(F.split(F.concat_ws("\n", "cite_raw", "body"), "\n"), lambda x: F.trim(x) != "")
    rows = cards.withColumn("_d", F.when(F.col("wiki"), documents.split_disclosed(lines)))
    for name, value in (("cite_raw", "_d.cite"), ("body", "_d.disclosed"), ("read_text", "_d.disclosed")):
        rows = rows.withColumn(name, F.when(F.col("wiki"), F.col(value)).otherwise(F.col(name)))
    return rows.drop("_d")


def ingest(found: DataFrame, out: str, force: bool = False) -> tuple[int, DataFrame]:
    """Append the cards of files whose source has none yet to the table ``out``; returns how many, and the files left out."""
    from citeloom.operators import store

    spark = found.sparkSession
    known = store.read_or_none(spark, out)
    new = found if known is None else files.new_files(found, known, force)
    cards, left_out = cards_of(new)
    cards = stage(cards, "new-cards")
    if known is not None:
        cards = store.insert_if_absent(known.select("card_id"), cards, "card_id")
    n = cards.count()
    cards.write.mode("append").parquet(out)
    return n, left_out
