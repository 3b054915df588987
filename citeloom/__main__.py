"""Command line: python -m citeloom COMMAND FOLDER ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from citeloom.operators import checks, graph, retrieval
from citeloom.session import local_session, table
from citeloom.sources import cards as ingest_cards
from citeloom.sources import bundle, dataset, files, packet


def ratio(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("a number from 0 to 1")
    return value


def year(text: str) -> int:
    value = int(text)
    if not 1900 <= value <= 2200:
        raise argparse.ArgumentTypeError("a year from 1900 to 2200")
    return value


def count(text: str) -> int:
    value = int(text)
    if not 1 <= value <= 100:
        raise argparse.ArgumentTypeError("a number from 1 to 100")
    return value


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="citeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, what):
        s = sub.add_parser(name, help=what)
        s.add_argument("folder", help="folder of the tables")
        return s

    add("stats", "sizes of the corpus")
    s = add("search", "hybrid search")
    s.add_argument("query")
    s.add_argument("-k", type=count, default=25)
    s.add_argument("--smart", action="store_true", help="read filters and variants from the request")
    for name, kind in (("side", str), ("author", str), ("year-min", year), ("year-max", year), ("block", str), ("min-read-ratio", ratio), ("source", str)):
        s.add_argument(f"--{name}", type=kind)
    s = add("graph", "write answer and duplicate edges")
    s.add_argument("out")
    s = add("analyze", "findings and scores of positions")
    s.add_argument("--owner")
    s.add_argument("--most", type=count, default=5)
    s.add_argument("--report", help="write all findings to this JSON file")
    s = add("packet", "a research packet of cards")
    s.add_argument("out")
    s.add_argument("cards", nargs="+")
    s = add("ingest-dataset", "dataset rows as cards")
    s.add_argument("rows")
    s.add_argument("out")
    s.add_argument("--source-id", default="dataset")
    s.add_argument("--limit", type=int)
    s = add("ingest", "files as cards: of a folder, of the ZIP files in it, or of a git repository")
    s.add_argument("out")
    s.add_argument("--adapter", choices=("local", "zip", "git"), default="local")
    s.add_argument("--url", help="repository to clone into the folder")
    s.add_argument("--force", action="store_true", help="also files whose source has cards")
    s.add_argument("--limit", type=int, default=0)
    s = add("scan", "files that can be parsed")
    s.add_argument("--limit", type=int, default=0)
    s = add("bundle-export", "a bundle of the tables")
    s.add_argument("out")
    add("bundle-inspect", "check a bundle")
    s = add("bundle-import", "unpack a checked bundle")
    s.add_argument("out")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run a command; with a session given, that is used and left open."""
    parser = build()
    a = parser.parse_args(argv)
    if getattr(a, "year_min", None) and getattr(a, "year_max", None) and a.year_min > a.year_max:
        parser.error("--year-min is after --year-max")
    if a.command == "bundle-inspect":
        print(json.dumps(bundle.inspect_bundle(a.folder)["tables"]))
        return 0
    made = spark is None
    spark = spark or local_session("*")
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "bundle-import":
        tables, _, dropped = bundle.restore_bundle(spark, a.folder, a.out)
        print(json.dumps({"tables": sorted(tables), "dropped_pins": dropped}))
    elif a.command == "scan":
        files.scan(spark, a.folder, a.limit).select("path", "source_id", "kind", "length").show(1_000, False)
    elif a.command == "ingest":
        if a.adapter == "git" and not a.url:
            parser.error("git needs --url")
        if a.adapter == "zip":
            found = files.archive_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(a.folder).select("path", "content"), a.limit)
        else:
            found = files.scan(spark, a.folder, a.limit) if a.adapter == "local" else files.git_files(spark, a.url, a.folder)
        n, left_out = ingest_cards.ingest(found, a.out, a.force)
        print(json.dumps({"cards": n}))
        left_out.orderBy("source_path").show(1_000, False)
    elif a.command == "ingest-dataset":
        dataset.to_cards(dataset.filter_rows(dataset.read_rows(spark, a.rows), limit=a.limit), a.source_id).write.mode("append").parquet(a.out)
    elif a.command == "bundle-export":
        print(json.dumps(bundle.export_bundle({t: table(spark, a.folder, t) for t in ("cards", "sources", "nodes", "relate")}, a.out)["tables"]))
    else:
        cards = table(spark, a.folder, "cards").drop("ingested_at").dropDuplicates(["card_id"])
        sources = table(spark, a.folder, "sources")
        if a.command == "stats":
            cards.agg(F.count("*").alias("cards"), F.countDistinct("cite_author").alias("authors"), F.countDistinct("source_id").alias("sources")).show()
        elif a.command == "search":
            stated = {n: getattr(a, n) for n in ("side", "author", "year_min", "year_max", "block", "min_read_ratio", "source") if getattr(a, n) is not None}
            if a.smart:
                hits = retrieval.smart_search(cards, a.query, a.k, **{n: v for n, v in stated.items() if n != "source"})
            else:
                allowed = retrieval.metadata_filter(cards, sources, **stated).select("card_id") if stated else None
                hits = retrieval.hybrid_search(cards, a.query, a.k, allowed=allowed)
            hits.join(cards.select("card_id", "tag", "cite_raw"), "card_id").orderBy(F.desc("score"), "card_id").show(a.k, 60)
        elif a.command == "graph":
            graph.answer_edges(table(spark, a.folder, "nodes")).write.mode("overwrite").parquet(f"{a.out}/answers")
            graph.duplicate_edges(cards).write.mode("overwrite").parquet(f"{a.out}/duplicates")
        elif a.command == "analyze":
            nodes, edges = table(spark, a.folder, "nodes"), table(spark, a.folder, "relate")
            scope = checks.scope_of(sources, a.owner)
            facts = checks.card_facts(cards)
            templates = checks.template_sources(cards, sources)
            places = checks.positions(nodes, scope, templates)
            p = checks.position_facts(places, facts)
            own = checks.position_findings(places, p, facts)
            checks.scores(p, own).orderBy(F.desc("priority"), "node_id").show(20, 60)
            held = cards if scope is None else cards.join(scope.distinct(), "source_id", "left_semi")
            mine = templates if scope is None else templates.join(scope.distinct(), "source_id", "left_semi")
            found = own.unionByName(checks.corpus_findings(places, p, facts, edges, nodes, mine, graph.duplicate_edges(held), scope))
            checks.capped(found, most=a.most).select("kind", "severity", "title", "hidden").show(200, 60)
            if a.report:
                part = Path(a.report + ".part")
                part.write_text("[" + ",\n".join(r[0] for r in found.select(F.to_json(F.struct("*"))).toLocalIterator()) + "]")
                part.replace(a.report)
        elif a.command == "packet":
            ids = spark.createDataFrame(list(enumerate(a.cards)), "pos int, card_id string")
            Path(a.out).write_bytes(packet.write_packet(cards, sources, ids))
    if made:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
