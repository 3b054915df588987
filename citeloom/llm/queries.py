"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import components, consensus, leakage, markup, names, neardup, packing, spans, subjects, tokens
from citeloom.llm.sql import ORACLE
from citeloom.session import table
from citeloom.staging import stage


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(table(spark, d, "relate").where("kind = 'duplicates'"), "src_node_id", "dst_node_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.best_records(table(spark, d, "cards"), p1_found(spark, d)).select("group_id", "card_id", "cite_card_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.link_names(names.card_spellings(table(spark, d, "cards"))))


def _card_texts(spark: SparkSession, d: str) -> DataFrame:
    """(field, key, text) of both card texts."""
    cards = table(spark, d, "cards")
    both = F.array(*[F.struct(F.lit(f"cards.{c}").alias("field"), F.col(c).alias("text")) for c in ("body", "read_text")])
    return cards.select("card_id", F.explode(both).alias("x")).select("x.field", "card_id", "x.text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    dataset = table(spark, d, "opendebate_rows").select(F.lit("opendebate_rows.fulltext").alias("field"), F.col("id").cast("string").alias("card_id"), F.col("fulltext").alias("text"))
    return neardup.near_duplicates(_card_texts(spark, d).unionByName(dataset), "field", "card_id", "text", width=3, least=0.7, least_words=20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_card_texts(spark, d), "field", "card_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "opendebate_rows").select("id", "markup", "fulltext")
    weights = markup.fit_weights(rows, "markup", "fulltext")
    a = markup.find_elements(rows, "id", "markup", weights).withColumn("field", F.lit("opendebate_rows.markup"))
    b = markup.find_elements(table(spark, d, "cards"), "card_id", "body", weights).withColumn("field", F.lit("cards.body"))
    # repeated rows have the same content, so it is their (small) results that are made distinct, not their texts
    return a.unionByName(b).select("field", "rec_key", "element", "seq").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = stage(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text"), "tokens")
    packs = [(r.pack_name, r.capacity_tokens) for r in table(spark, d, "pack_sizes").orderBy("pack_name").collect()]
    return packing.fill_containers(sizes, "doc_id", "tokens", packs)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, d, "documents"), table(spark, d, "doc_subjects"), table(spark, d, "subjects"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_containers, p8_found, p9_found)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
