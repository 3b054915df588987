import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from citeloom.operators import checks, graph, models, neighbours, retrieval, store
from citeloom.skew import lookup_join, small_join
from citeloom.sources import bundle, dataset, documents, files, packet, policy
from citeloom.streaming import ingest


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


# joins


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skewed_joins_equal_plain_ones(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(60)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("a", "A"), ("z", "Z")], "k string, w string")
    want = rows(left.join(right, "k", how))
    assert rows(lookup_join(left, right, ["k"], how, hot_rows=20)) == want == rows(lookup_join(left, right, ["k"], how)) == rows(small_join(left, right, ["k"], how)) == rows(small_join(left, right, ["k"], how, most=1))


# graph


def test_answer_edges(spark):
    n = [("n1", "Port Fees Rise"), ("n2", "AT: Port Fees Rise"), ("n3", "Port Fees"), ("n4", "Reef Loss"), ("n5", "AT: nothing like it"), ("n6", None), ("n7", "AT: Reef Loss"), ("n8", "Reef loss")]
    got = rows(graph.answer_edges(spark.createDataFrame(n, "node_id string, title string")), "src", "dst", "confidence")
    assert got == [("n2", "n1", 1.0), ("n2", "n3", 0.667), ("n7", "n4", 1.0), ("n7", "n8", 1.0)]
    many = [("q", "AT: Sea Walls")] + [(f"t{i:02d}", "Sea walls") for i in range(20)]
    assert [r[1] for r in rows(graph.answer_edges(spark.createDataFrame(many, "node_id string, title string")), "src", "dst")] == [f"t{i:02d}" for i in range(8)]


@pytest.mark.parametrize("least", [0.2, 0.45, 0.8])
def test_answer_edges_equal_all_pairs(spark, least):
    rnd = random.Random(7)
    words = [f"w{i:02d}" for i in range(12)] + [f"v{i:03d}" for i in range(90)]
    titles = [" ".join(rnd.sample(words[:12], rnd.randint(1, 8))) for _ in range(150)] + [" ".join(rnd.sample(words, rnd.choice([20, 35, 60, 90]))) for _ in range(40)] + ["of it", "to", "", None, "w01 w01", "W01, w02!"]
    titles += [" ".join(t.split()[:-5] + rnd.sample(words, 5)) for t in titles[150:190]]
    n = [(f"n{i:03d}", ("AT: " + t if i % 3 == 0 and t else t)) for i, t in enumerate(titles + rnd.sample(titles, 60))]
    got = rows(graph.answer_edges(spark.createDataFrame(n, "node_id string, title string"), least, 5), "src", "dst", "confidence")
    norm = {i: " ".join(t.removeprefix("AT: ").lower().replace(",", "").replace("!", "").split()) for i, t in n if t is not None}
    sets = {i: {w for w in t.split() if len(w) > 2} for i, t in norm.items()}
    asks = {i for i, t in n if t and t.startswith("AT: ")}
    want = []
    for a in asks:
        near = []
        for b in norm.keys() - asks:
            both = len(sets[a] | sets[b])
            s = 0.0 if not norm[a] or not norm[b] else 1.0 if norm[a] == norm[b] else len(sets[a] & sets[b]) / both if both else 0.0
            if s >= least:
                near.append((-s, b))
        want += [(a, b, int(-s * 1000 + 0.5 + 1e-9) / 1000) for s, b in sorted(near)[:5]]
    assert got == sorted(want) and len(want) > 50


def test_titles_with_a_frequent_word_do_not_meet_on_it(spark):
    t = spark.range(3000).selectExpr("concat('x', id) norm", "array('energy', concat('a', id), concat('b', id), 'policy') tokens", "4 n")
    o = spark.range(3000).selectExpr("concat('y', id) norm", "array('energy', concat('c', id), concat('d', id), 'policy') tokens", "4 n")
    a, b = graph.title_keys(t, o, 0.45), graph.title_keys(o, t, 0.45)
    assert a.count() > 0 and a.join(b, "t").count() == 0  # every pair shares two words


def test_duplicate_edges_match_brute_force(spark):
    rng = random.Random(2)
    base = [rng.choices([f"w{i}" for i in range(60)], k=rng.randrange(3, 30)) for _ in range(12)]
    cards = []
    for i in range(60):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w = w[: rng.randrange(1, len(w) + 1)]
        cards.append((f"c{i:02d}", rng.choice(["Tag", "tag ", "Other"]), rng.choice(["Ann", "ann", "Bob", None]), rng.choice([2001, 2002]), " ".join(w)))
    sh = {c[0]: {tuple(c[4].split()[i : i + 5]) for i in range(max(1, len(c[4].split()) - 4))} for c in cards}
    want = [(a[0], b[0], a[1].strip().lower() != b[1].strip().lower()) for a in cards for b in cards if a[0] < b[0] and a[2] and b[2] and a[2].lower() == b[2].lower() and a[3] == b[3] and len(sh[a[0]] & sh[b[0]]) >= 0.8 * min(len(sh[a[0]]), len(sh[b[0]]))]
    got = rows(graph.duplicate_edges(spark.createDataFrame(cards, "card_id string, tag string, cite_author string, cite_year int, read_text string")), "src", "dst", "retagged")
    assert got == sorted(want)


def test_sections(spark):
    p = [("d", 0, 1, "P"), ("d", 1, 2, "H"), ("d", 2, 4, "Tag one"), ("d", 3, None, "Cite one"), ("d", 4, None, "Body"), ("d", 5, None, "More"), ("d", 6, 2, "H2"), ("d", 7, None, "stray"), ("d", 8, 4, "Tag two"), ("d", 9, None, "Cite two")]
    got = rows(graph.sections(spark.createDataFrame(p, "doc string, ordinal int, level int, text string")), "card_no", "tag", "path", "cite", "body")
    assert got == [(1, "Tag one", ["P", "H"], "Cite one", "Body\nMore"), (2, "Tag two", ["P", "H2"], "Cite two", "")]


# retrieval


def docs(spark):
    r = [("a", "port fees", "port fees rise again", "Ann 2001", "long body on port fees"), ("b", "reef loss", "reefs are lost", "Bob", "nothing on ports"), ("c", "fees", "fees", None, None), ("d", None, None, None, "")]
    return spark.createDataFrame(r, "card_id string, tag string, read_text string, cite_raw string, body string")


def test_query_tree_and_bm25(spark):
    assert retrieval.query_tree('port "reef loss" OR fees NOT ann') == [[("+", "port"), ("+", "reef loss")], [("+", "fees"), ("-", "ann")]]
    assert retrieval.query_tree("NOT x") == [] and retrieval.query_tree('"\'*(') == []
    d = docs(spark)
    assert [r.card_id for r in retrieval.bm25(d, "card_id", "fees").collect()] == ["c", "a"] or [r.card_id for r in retrieval.bm25(d, "card_id", "fees").collect()] == ["a", "c"]
    assert [r.card_id for r in retrieval.bm25(d, "card_id", "port fees").collect()] == ["a"]
    assert [r.card_id for r in retrieval.bm25(d, "card_id", '"reef loss" OR rise').collect()] == ["b", "a"]
    assert [r.card_id for r in retrieval.bm25(d, "card_id", "fees NOT port").collect()] == ["c"]
    assert retrieval.bm25(d, "card_id", "unheard").count() == 0 == retrieval.bm25(d, "card_id", " ").count() == retrieval.bm25(d.limit(0), "card_id", "fees").count()


def test_vectors_coverage_and_hybrid(spark):
    d = docs(spark)
    vec = retrieval.tfidf_vectors(d.selectExpr("card_id", "read_text text"), "card_id", "text")
    assert all(abs(r.n - 1) < 1e-9 for r in vec.groupBy("card_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect())
    q = vec.where("card_id = 'a'").selectExpr("'q' q", "term", "w")
    assert [r.card_id for r in retrieval.coverage(vec, q, "card_id", "q", 0.9).collect()] == ["a"]
    assert retrieval.coverage(vec, q, "card_id", "q", 0.1, without=spark.createDataFrame([("q", "a"), ("q", "c")], "q string, card_id string")).count() == 0
    assert retrieval.coverage(vec, q, "card_id", "q", 0.1, within=vec.limit(0)).count() == 0
    assert retrieval.hybrid_search(d, "port fees", 2).first().card_id == "a"
    assert retrieval.hybrid_search(d, "  ", 2).count() == 0 == retrieval.hybrid_search(d, "port", 0).count() == retrieval.hybrid_search(d, "unheard", 5, mode="strict").count()
    allowed = spark.createDataFrame([("b",)], "card_id string")
    assert {r.card_id for r in retrieval.hybrid_search(d, "port fees", 5, allowed=allowed, mode="explore").collect()} <= {"b"}
    one = spark.createDataFrame([("x", "only text here")], "card_id string, text string")
    assert retrieval.tfidf_vectors(one, "card_id", "text").count() > 0


@pytest.mark.parametrize(("k", "block"), [(1, 100), (4, 10_000)])
def test_neighbours_equal_all_pairs(spark, k, block):
    rnd = random.Random(5)
    words = [f"w{i:03d}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(300)], k=rnd.choice([1, 3, 12, 40]))) for _ in range(880)]
    r = [(f"{i:04d}", t) for i, t in enumerate([*texts, *texts[:30], *[texts[5]] * 12, "", None, "the of", "w001 w002"])]
    d = spark.createDataFrame(r + r[:9], "id string, body string")
    asked = F.col("id").endswith("5") | (F.col("id") > "0880")
    got = neighbours.tfidf_neighbours(d, "id", "body", asked, k, 0.1, max_features=900, block=block)
    assert got.columns == ["q", "id", "score", "rank"] and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    vec: dict = {}
    for v in retrieval.tfidf_vectors(d.distinct(), "id", "body", max_features=900).collect():
        vec.setdefault(v.id, {})[v.term] = v.w
    want = {}
    for q in vec:
        if q.endswith("5") or q > "0880":
            near = [(-round(sum(w * vec[i].get(t, 0.0) for t, w in vec[q].items()), 9), i) for i in vec if i != q]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(sorted(x for x in near if x[0] < -0.1)[:k])}
    assert {(x["q"], x["rank"]): (x["id"], round(x["score"], 9)) for x in got.collect()} == want
    assert len(want) > 100 * k


def test_neighbours_of_nothing(spark):
    d = spark.createDataFrame([("a", ""), ("b", None), ("c", "the of")], "id string, body string")
    assert neighbours.tfidf_neighbours(d, "id", "body", F.lit(True)).count() == 0 == neighbours.tfidf_neighbours(d.limit(0), "id", "body", F.lit(True)).count()
    one = spark.createDataFrame([("a", "port fees"), ("b", "port fees"), ("c", "reef")], "id string, body string")
    assert rows(neighbours.tfidf_neighbours(one, "id", "body", F.col("id") != "b", max_df=0.1).select("q", "id", F.round("score", 9), "rank")) == [("a", "b", 1.0, 1)]


def test_small_pool_filter(spark):
    r = [(f"x{i:02d}", "port fees", "port fees port fees", "c", "b", "neg", None, None, 2000, 0.5, "s") for i in range(80)] + [("t", "port", "port once", "c", "b", "aff", "Ann", None, 2010, 0.5, "s")]
    cards = spark.createDataFrame(r, "card_id string, tag string, read_text string, cite_raw string, body string, side string, cite_author string, block string, cite_year int, read_ratio double, source_id string")
    allowed = retrieval.metadata_filter(cards, None, side="aff", author="ANN", year_min=2005, year_max=2015)
    assert [x.card_id for x in retrieval.hybrid_search(cards, "port", 1, allowed=allowed).collect()] == ["t"]
    assert [x.card_id for x in retrieval.smart_search(cards, "find affirmative cards since 2005 about port", 1).collect()] == ["t"]


@pytest.mark.parametrize(
    "text,plain,filters",
    [
        ("negative cards from 2024 about reefs", "reefs", {"side": "neg", "year_min": 2024}), ("find evidence in 2020 on ports", "ports", {"year_min": 2020, "year_max": 2020}),
        ("between 2015 and 2010 reefs", "reefs", {"year_min": 2010, "year_max": 2015}), ("reefs", "reefs", {}), ("aff side ports before 2001", "ports", {"side": "aff", "year_max": 2001}),
    ],
)
def test_smart_request(spark, text, plain, filters):
    assert retrieval.smart_request(spark, text) == (plain, filters)


def test_variants_and_fusion(spark):
    assert retrieval.query_variants(spark, "Find cards about nuclear costs") == ["Find cards about nuclear costs", "nuclear costs", "reactor costs", "nuclear cost"]
    assert retrieval.query_variants(spark, "  ") == []
    h = spark.createDataFrame([(0, "a", 1.0, "low", 0), (1, "a", 1.35, "high", 2), (0, "b", 1.5, "m", 1)], "variant int, card_id string, score double, confidence string, strength int")
    got = [(r.card_id, round(r.score, 6), r.confidence, r.variants) for r in retrieval.fuse_variants(h, "card_id").collect()]
    assert got == [("a", 2.0, "high", [0, 1]), ("b", 1.5, "m", [0])]
    lex = spark.createDataFrame([("a", 1), ("b", 2)], "k string, rank int")
    vec = spark.createDataFrame([("b", 1), ("c", 2)], "k string, rank int")
    assert [r.k for r in retrieval.fuse_ranks(lex, vec, "k").collect()] == ["b", "a", "c"]


# checks

CARDS = "card_id string, source_id string, source_path string, path array<string>, side string, cite_year int, tag string, read_ratio double, read_text string, body string, disclosed_only boolean, cite_author string, cite_raw string, cite_pub string"


def position(spark, cards, extra_nodes=(), edges=()):
    full = [("c" + str(i), "s", "/x/own/f.docx", ["P"], c.get("side"), c.get("year", 2020), c.get("tag", "t"), c.get("ratio", 0.5), c.get("read", "words read"), c.get("body", "body"), c.get("disclosed"), c.get("author", f"Author{i}xyz"), c.get("cite", "prof"), c.get("pub")) for i, c in enumerate(cards)]
    facts = checks.card_facts(spark.createDataFrame(full, CARDS))
    nodes = spark.createDataFrame([("n", "Title", "s", ["P"], len(cards)), *extra_nodes], "node_id string, title string, source_id string, path array<string>, card_count int")
    places = checks.positions(nodes)
    p = checks.position_facts(places, facts)
    e = spark.createDataFrame(list(edges), "src_node_id string, dst_node_id string, kind string")
    none = spark.createDataFrame([], "src string, dst string, retagged boolean")
    empty = spark.createDataFrame([], "source_id string, n bigint")
    found = checks.position_findings(places, p, facts).unionByName(checks.corpus_findings(places, p, facts, e, nodes, empty, none))
    return p, found, {r.kind: r.severity for r in found.collect()}


def test_checks_fire_and_stay_quiet(spark):
    good = [{"author": a} for a in ("Adams", "Brown", "Clark", "Davis")]
    assert position(spark, good)[2] == {}
    assert position(spark, good[:1])[2] == {"single_card_contention": "major"}
    assert position(spark, [{"author": "Adams"}] * 4)[2] == {"source_concentration": "major"}
    assert position(spark, [{"author": "Bostrom"}, {"author": "Bostrum"}, {"author": "N. Bostrom"}, {"author": None}])[2] == {"source_concentration": "major"}
    assert position(spark, [*good[:2], {"read": " "}])[2] == {"no_read_text": "major"} and position(spark, [*good[:2], {"read": " ", "disclosed": True}])[2] == {}
    assert position(spark, [*good[:2], {"ratio": 0.05}])[2] == {"thin_read": "minor"} and position(spark, [*good[:2], {"ratio": float("nan")}])[2] == {}
    assert position(spark, [{"cite": "x"}, {"cite": "y"}])[2] == {"qualification_gap": "major"} and position(spark, [{"cite": "x", "pub": "Post"}, {"cite": "y", "pub": "Post"}])[2] == {}
    tagged = {"tag": "Fees cause collapse", "read": "fees may hurt", "ratio": 0.1}
    assert position(spark, [*good, tagged])[2] == {"power_tagging": "major", "thin_read": "minor"}


def test_answers_recency_scores(spark):
    far = ("m", "Later", "s", ["Q"], 0)
    _, _, got = position(spark, [{"year": 2010, "author": a} for a in ("Adams", "Brown")], [far, ("a1", "AT: Title", "s", ["R"], 1)], [("a1", "n", "answers")])
    assert got == {"answer_gap": "minor"}
    _, _, got = position(spark, [{"author": a} for a in ("Adams", "Brown")], [far], [("x", "m", "answers")])
    assert got == {"unanswered_position": "info"}
    p, found, _ = position(spark, [{"author": "Adams", "year": 2000}])
    assert checks.finding_cards(found, spark.createDataFrame([("n", "s", ["P"])], "node_id string, source_id string, path array<string>"), checks.card_facts(spark.createDataFrame([("c0", "s", None, ["P"], None, 2020, "t", 0.05, "r", "b", None, "A", None, "P")], CARDS))).count() == 1
    s = checks.scores(p, found).first()
    assert 0 <= s.support <= 1 and s.exposure == round(1 - 1 / 1.45, 3) and s.priority == round(0.65 * (1 - 1 / 1.45) + 0.35 / 6, 3)
    assert checks.first_findings(found.unionByName(found)).count() == found.count()
    c = checks.capped(found.unionByName(found.withColumn("title", F.lit("z"))), most=1).first()
    assert (c.place, c.hidden) == (1, 1)


def test_scope_never_widens(spark):
    sources = spark.createDataFrame([("s", "/x/own", "T"), ("r", "/y", "U")], "source_id string, path string, title string")
    nodes = spark.createDataFrame([("n", "Title", "s", ["P"], 1), ("o", "Other", "r", ["P"], 1)], "node_id string, title string, source_id string, path array<string>, card_count int")
    assert checks.positions(nodes, checks.scope_of(sources, None)).count() == 2
    assert checks.positions(nodes, checks.scope_of(sources, "OWN")).count() == 1
    assert checks.positions(nodes, checks.scope_of(sources, "nobody")).count() == 0


def test_grounding(spark):
    cards = spark.createDataFrame([("a", "Tag", "port fees rise every year in the north", None, "Ann"), ("b", "T", "reefs", "body", None)], "card_id string, tag string, read_text string, body string, cite_raw string")
    f = [
        ("f1", "critical", 0.9, ["C1", "[1]", "b"], ["port fees rise every year"], ["a", "b"]), ("f2", "critical", 0.9, ["C9", "zz"], [], ["a", "b"]),
        ("f3", "major", 0.9, ["C2"], ["something that was never said here"], ["a", "b"]), ("f4", "info", 0.2, None, None, ["a"]),
    ]
    df = spark.createDataFrame(f, "finding_id string, severity string, confidence double, labels array<string>, quotes array<string>, shown array<string>")
    got = {r.finding_id: (r.severity, r.confidence, r.card_ids, len(r.quotes), r.grounded) for r in checks.ground(df, cards).collect()}
    assert got == {"f1": ("critical", 0.9, ["a", "b"], 1, True), "f2": ("minor", 0.3, [], 0, False), "f3": ("major", 0.6, ["b"], 0, True), "f4": ("info", 0.2, [], 0, False)}


def test_chains_proposals(spark):
    s = spark.createDataFrame([("p", 1, "missing"), ("p", 2, "missing"), ("p", 3, "weak"), ("p", 4, "supported")], "position string, step int, status string")
    assert rows(checks.chain_findings(s), "step", "kind", "severity") == [(1, "chain_break", "major"), (2, "chain_break", "critical"), (3, "warrant_mismatch", "major")]
    d = spark.createDataFrame([("p", 1, "Port fees rise"), ("p", 2, "Port fees rise now"), ("p", 3, "Reef loss")], "position string, priority int, title string")
    assert rows(checks.distinct_proposals(d), "title") == [("Port fees rise",), ("Reef loss",)]
    m = spark.createDataFrame([("a", 0.7), ("a", 0.5), ("b", 0.4)], "proposal_id string, score double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "proposal_id string")
    assert rows(checks.proposal_coverage(asked, m, spark.range(200)), "proposal_id", "state") == [("a", "have"), ("b", "partial"), ("c", "none")]
    assert rows(checks.proposal_coverage(asked, m, spark.range(10)), "proposal_id", "state")[0] == ("a", "partial")


def test_models(spark, tmp_path):
    cards = spark.createDataFrame([("n", "a", 1, "Tag", "Ann", "read this", None), ("n", "b", 2, "Tag", None, "", "body")], "node_id string, card_id string, ordinal int, tag string, cite_raw string, read_text string, body string")
    prompts = models.presented(cards)
    p = prompts.first()
    assert p.shown == ["a", "b"] and p.text.startswith("[C1] Tag") and "Read: body" in p.text
    answers = ["rubbish", '```json\n{"findings": [{"kind": "k", "title": "T", "labels": ["C1"], "confidence": 7}, {"kind": "other", "title": "U"}, {"kind": "k"},]}\n```']
    provider = models.Cached(models.Scripted(answers), str(tmp_path))
    got = models.critique(spark, prompts, provider, {"k"}, "Judge.").collect()
    assert [(r.title, r.confidence, r.labels) for r in got] == [("T", 0.5, ["C1"])] and provider.calls == 2
    assert models.critique(spark, prompts, models.Cached(models.Scripted([]), str(tmp_path)), {"k"}, "Judge.").count() == 1
    c = models.chains(spark, prompts, models.Scripted(['{"chain": [{"claim": "x", "status": "supported", "labels": ["C1"]}, {"claim": "y", "status": "supported", "labels": ["C9"]}]}']), "Chain.")
    assert rows(c, "step", "status") == [(1, "supported"), (2, "missing")]


# store


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    b = spark.createDataFrame([("b", 2), ("c", 2), ("c", 2), (None, 3)], "k string, v int")
    assert rows(store.insert_if_absent(a, b, "k")) == [("c", 2)]
    assert rows(store.upsert(a, b.where("k is not null").distinct(), ["k"])) == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(store.latest_rows(a.unionByName(b.where("k is not null")), ["k"], ["v"])) == [("a", 1), ("b", 2), ("c", 2)]
    s = store.Snapshots(spark, str(tmp_path / "snap"))
    s.replace({"t": a, "u": b})
    first = s.current()["version"]
    with pytest.raises(ValueError):
        s.replace({"t": a.limit(0)})
    assert s.current()["version"] == first and s.read("t").count() == 2
    s.replace({"t": b})
    assert s.read("t").count() == 4 and s.read("u").count() == 4
    assert rows(store.fingerprint(a, "k")) == rows(store.fingerprint(a.unionByName(a).orderBy(F.desc("k")), "k")) != rows(store.fingerprint(b, "k"))


def test_jobs_and_deletes(spark):
    log = spark.createDataFrame([("j", "importing", None, list("abcdefg"), 2.0), ("j", "queued", None, [], 1.0), ("j", "importing", None, list("abcdefg"), 2.0), ("d", "completed", None, [], 9.0)], "job_id string, state string, error string, details array<string>, updated_at double")
    j = store.latest_jobs(log)
    assert rows(j, "job_id", "state", F.size("details")) == [("d", "completed", 0), ("j", "importing", 5)]
    assert rows(store.recover_jobs(j), "job_id", "state") == [("d", "completed"), ("j", "failed")]
    src = spark.createDataFrame([("s", None, None), ("r", None, None)], "source_id string, last_refresh_failed_at string, last_refresh_error string")
    cards = spark.createDataFrame([("c1", "s"), ("c2", "r")], "card_id string, source_id string")
    nodes = spark.createDataFrame([("n1", "s"), ("n2", "r")], "node_id string, source_id string")
    edges = spark.createDataFrame([("c1", "c2", "d"), ("c2", "c3", "d"), ("n1", "n2", "a"), (None, "c2", "d")], "src_node_id string, dst_node_id string, kind string")
    left = store.delete_sources(src.where("source_id = 's'"), src, cards, nodes, edges)
    assert rows(left["edges"]) == rows(edges.where("dst_node_id = 'c3' or src_node_id is null")) and left["cards"].count() == left["nodes"].count() == left["sources"].count() == 1
    f = store.mark_failure(src, spark.createDataFrame([("s", "x" * 2000)], "source_id string, error string"), "now")
    assert rows(f, "source_id", "last_refresh_failed_at", F.length("last_refresh_error")) == [("r", None, None), ("s", "now", 1000)]


# sources


def docx_bytes():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {w}><w:style w:styleId="H4"><w:name w:val="heading 4"/></w:style><w:style w:styleId="Base"><w:name w:val="Style Underline"/></w:style><w:style w:styleId="Kid"><w:name w:val="kid"/><w:basedOn w:val="Base"/></w:style></w:styles>'
    body = f"""<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H4"/></w:pPr><w:r><w:t>The tag</w:t></w:r></w:p>
    <w:p><w:r><w:t>Ann 2001</w:t></w:r></w:p><w:p><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:u w:val="single"/></w:rPr><w:t>read one</w:t></w:r><w:r><w:t> skipped </w:t></w:r>
    <w:r><w:rPr><w:rStyle w:val="Kid"/><w:b/></w:rPr><w:t>read two</w:t></w:r><w:r><w:rPr><w:u w:val="none"/><w:rStyle w:val="Kid"/></w:rPr><w:t> off</w:t></w:r></w:p></w:body></w:document>"""
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/styles.xml", styles)
        z.writestr("word/document.xml", body)
    return b.getvalue()


def test_documents(spark):
    df = spark.createDataFrame([("s", bytearray(docx_bytes())), ("bad", bytearray(b"nonsense"))], "source_id string, content binary")
    got = documents.read_docx(df).orderBy("source_id", "ordinal").collect()
    assert [r.style for r in got if r.source_id == "bad"] == ["!failed"]
    p = [r for r in got if r.source_id == "s"]
    assert [r.level for r in p] == [4, None, None] and p[2].read_text == "read one … read two" and p[2].emphasis_text == "read two" and p[2].runs == 5
    cards = graph.sections(spark.createDataFrame([("s", r.ordinal, r.level, r.text) for r in p], "doc string, ordinal int, level int, text string"))
    assert rows(cards, "tag", "cite") == [("The tag", "Ann 2001")]
    assert rows(files.health(documents.read_docx(df.where("source_id = 's'"))), "runs", "marked", "unmarked") == [(7, 2, False)]


def test_files_become_cards(spark, tmp_path, capsys):
    from citeloom.__main__ import main

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.docx").write_bytes(docx_bytes())
    (src / "bad.docx").write_bytes(b"nonsense")
    (src / "page.htm").write_bytes(b'<html class="wiki"><h4 class="title">Entry</h4><h4 class="wikigeneratedheader">Wiki tag</h4><p>Ann Example 2001<br/>First words</p><p>AND</p><p>last words</p></html>')
    (src / "other.html").write_bytes(b"<html><p>x</p></html>")
    out = str(tmp_path / "cards")
    assert main(["ingest", str(src), out], spark) == 0
    got = {r.tag: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {"The tag", "Wiki tag"}
    assert got["The tag"].cite_raw == "Ann 2001" and got["The tag"].read_text == "read one … read two" and got["The tag"].emphasis_text == "read two" and 0 < got["The tag"].read_ratio < 1 and not got["The tag"].disclosed_only
    w = got["Wiki tag"]
    assert (w.cite_raw, w.cite_year, w.body, w.read_text, w.path, w.disclosed_only) == ("Ann Example 2001", 2001, "First words … last words", "First words … last words", ["Entry"], True)
    shown = capsys.readouterr().out
    assert '{"cards": 2}' in shown and "unreadable" in shown and "no wiki page" in shown
    assert main(["ingest", str(src), out], spark) == 0 and '{"cards": 0}' in capsys.readouterr().out and spark.read.parquet(out).count() == 2


def test_wiki(spark):
    page = b'<html class="wiki"><h4 class="title">Entry</h4><h4 class="wikigeneratedheader">Tag &amp; more</h4><p>Ann 2001<br/>First words</p><p>AND</p></html>'
    df = spark.createDataFrame([("s", bytearray(page))], "source_id string, content binary")
    assert [r[0] for r in df.select(documents.is_wiki_page(F.col("content"))).collect()] == [True]
    assert [(r.level, r.text) for r in documents.read_wiki(df).orderBy("ordinal").collect()] == [(3, "Entry"), (4, "Tag & more"), (None, "Ann 2001\nFirst words"), (None, "AND")]
    s = spark.createDataFrame([(["Cite", "First.", "AND", "Last."],)], "l array<string>").select(documents.split_disclosed(F.col("l")).alias("x")).select("x.*")
    assert rows(s) == [("Cite", "First. … Last.")]


def test_files_archives_dispatch(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.docx", "~$a.docx", "sub/b.HTM", "c.exe"):
        (tmp_path / name).write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("ok/a.docx", "../up.docx", "/abs.docx", "no.exe", "b.pdf"):
            z.writestr(name, b"data")
    got = files.scan(spark, str(tmp_path))
    assert sorted(r.path.rpartition("/")[2] for r in got.collect()) == ["a.docx", "b.HTM"] and files.scan(spark, str(tmp_path), 1).count() == 1
    z = spark.read.format("binaryFile").load(str(tmp_path / "z.zip")).select("path", "content")
    assert [r.path.rpartition("!")[2] for r in files.archive_members(z).orderBy("path").collect()] == ["b.pdf", "ok/a.docx"] and files.archive_members(z, 1).count() == 1
    assert files.archive_members(spark.createDataFrame([("p", bytearray(b"no"))], "path string, content binary")).count() == 0
    _, skipped = files.dispatch(files.archive_members(z), {"docx": lambda f: f.select("path")})
    assert rows(skipped, "reason") == [("unsupported: pdf",)]
    pages = spark.createDataFrame([("s", 1, "Ann 2001 cites\n" + "words " * 20), ("s", 2, "short")], "source_id string, page int, text string")
    assert rows(files.page_cards(pages), "tag", "read_text", "disclosed_only") == [("Ann 2001 cites", "", True)]
    text = ["A stray tag", "Ann, 2001 (professor of law, https://a.example)", "Body.", "Next tag", 'Bob, 2002 ("A quoted title here")', "More."]
    par = spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "source_id string, ordinal int, text string")
    assert rows(files.fallback_cards(par), "tag", "body") == [("A stray tag", "Body.\nNext tag"), ("Next tag", "More.")]
    plan = files.download_plan(spark.createDataFrame([("https://a.b/x.pdf?q",), ("https://a.b/x.pdf?q",), (None,)], "url string"), "/t")
    assert plan.count() == 1 and plan.first().target.endswith("-x.pdf")


def test_policy_and_links(spark):
    rules = spark.createDataFrame([("a.example", "open"), ("deep.a.example", "gated"), ("b.example", "attributed")], "host string, tier string")
    urls = spark.createDataFrame([("https://a.example/x",), ("https://www.A.example",), ("https://x.deep.a.example",), ("https://nota.example",), ("not a url",), (None,)], "url string")
    got = {r.url: r.tier for r in policy.check_urls(urls, rules).collect()}
    assert list(got.values()) == ["open", "open", "gated", "refused", "refused", "refused"] or set(got.items()) == {("https://a.example/x", "open"), ("https://www.A.example", "open"), ("https://x.deep.a.example", "gated"), ("https://nota.example", "refused"), ("not a url", "refused"), (None, "refused")}
    pages = spark.createDataFrame([("https://a.example/i/", '<a href="f.docx">x</a><a href="/g.pdf?v=1">y</a><a href="f.docx#top">z</a><a href="https://c.example/h.pdf">w</a><a href="nav.php">n</a>'), ("https://b.example/d.pdf", None)], "url string, html string")
    assert sorted(r.link for r in policy.discover_links(pages, rules).collect()) == ["https://a.example/g.pdf?v=1", "https://a.example/i/f.docx", "https://b.example/d.pdf"]


def test_packet_and_bundle(spark, tmp_path):
    schema = "card_id string, tag string, side string, cite_raw string, cite_author string, cite_year int, cite_pub string, cite_url string, block string, pocket string, source_id string, read_text string, disclosed_only boolean"
    cards = spark.createDataFrame([(f"c{i}", "Tag", ("aff", "odd")[i % 2], "Ann 2001", "Ann Ek", 2001, None, None, None, None, "s", "read", False) for i in range(3)], schema)
    sources = spark.createDataFrame([("s", "Source", None)], "source_id string, title string, url string")
    ids = spark.createDataFrame([("c2", 0), ("c0", 1), ("gone", 2), ("c0", 3)], "card_id string, pos int")
    with zipfile.ZipFile(io.BytesIO(packet.write_packet(cards, sources, ids))) as z:
        m = json.loads(z.read("manifest.json"))
        assert m["cards"] == 2 and m["missing"] == ["gone"] and "@misc{ek2001," in z.read("references.bib").decode() and "@misc{ek2001a," in z.read("references.bib").decode() and z.read("cards.csv").decode().count("\n") == 3
    target = str(tmp_path / "b.zip")
    bundle.export_bundle({"cards": cards}, target, {"pins": ["c1", "gone"]})
    tables, state, dropped = bundle.restore_bundle(spark, target, str(tmp_path / "out"))
    assert rows(tables["cards"]) == rows(cards) and state["pins"] == ["c1"] and dropped == ["gone"]
    with zipfile.ZipFile(target) as z, zipfile.ZipFile(tmp_path / "bad.zip", "w") as y:
        for n in z.namelist():
            y.writestr(n, z.read(n) if n != "state.json" else b'{"pins": 0    }      '[: len(z.read(n))])
    for bad in (tmp_path / "bad.zip", tmp_path / "absent.zip"):
        with pytest.raises(ValueError):
            bundle.restore_bundle(spark, str(bad), str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists() and not bundle.safe_name("../x") and bundle.safe_name("a/b")


def test_dataset_stream_restarts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, ids):
        (src / name).write_text("\n".join(json.dumps({"id": i, "tag": "t", "spoken": "said" if i % 4 else " ", "fulltext": "all said", "side": "A", "event": "cx", "year": 2015, "round": "NA", "tournament": "Cup"}) for i in ids))

    def run():
        ingest.import_stream(spark, str(src), str(tmp_path / "cards"), str(tmp_path / "chk"), "ds", events=["cx"]).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "cards"))

    put("a.json", [1, 2, 3, 4, 1])
    assert run().count() == 3
    put("b.json", [3, 5])
    c = run()
    assert rows(c, "ordinal") == [(1,), (2,), (3,), (5,)] and c.first().round_context == "Tournament: Cup" and c.first().side == "aff"
    assert dataset.filter_rows(dataset.read_rows(spark, str(src)), limit=2).count() == 2
    jobs = spark.createDataFrame([("j", 2.0, "b", 1, 1, None), ("j", 1.0, "a", 0, 0, None)], "job_id string, updated_at double, state string, processed int, imported int, error string")
    assert rows(ingest.job_states(jobs), "job_id", "state") == [("j", "b")]


def test_index_and_reports(spark, tmp_path):
    from citeloom.operators import index, report

    d = docs(spark).withColumn("source_id", F.lit("s")).withColumn("path", F.array(F.lit("P"))).withColumn("ordinal", F.lit(1))
    folder = str(tmp_path / "index")
    v = index.current(d, folder)
    assert v.count() > 0 and index.load(spark, folder, index.corpus_mark(d)).count() == v.count()
    assert index.load(spark, folder, index.corpus_mark(d.limit(1))) is None
    index.save(index.fit(d), folder, index.corpus_mark(d))  # a new version beside the old one
    assert len(list((tmp_path / "index").glob("manifest-*.json"))) == 2 and index.load(spark, folder, index.corpus_mark(d)).count() == v.count()
    newest = max((tmp_path / "index").glob("manifest-*.json"))
    newest.write_text("{")
    newest.with_name(f".{newest.name}.crc").unlink(missing_ok=True)
    assert index.load(spark, folder, index.corpus_mark(d)) is None and index.load(spark, str(tmp_path / "none"), "x") is None
    sources = spark.createDataFrame([("s", "o", "2020-01-01"), ("r", "o", "no date"), ("q", "o", "2021-01-01")], "source_id string, origin string, fetched_at string")
    edges = spark.createDataFrame([("b", "a", "duplicates"), ("a", "c", "duplicates")], "src_node_id string, dst_node_id string, kind string")
    got = report.card_detail(d, sources, edges, "a", 2)
    assert rows(got["duplicates"], "other") == [("b",), ("c",)] and got["source"].count() == 1 and "a" not in {r.card_id for r in got["similar"].collect()}
    assert [r.source_id for r in report.newest_sources(sources, "o").collect()] == ["q", "s", "r"]
    nodes = spark.createDataFrame([("n", None, "s", ["P"], "T", 3), ("k", "n", "s", ["P", "Q"], "U", 0)], "node_id string, parent_id string, source_id string, path array<string>, title string, card_count int")
    n = report.node_detail(nodes, d, edges, "n")
    assert n["cards"].count() == 4 and [r.node_id for r in n["children"].collect()] == ["k"]
    _, found, _ = position(spark, [{"author": "Adams", "year": 2000}])
    p, found, _ = position(spark, [{"author": "Adams"}] * 4)
    t = report.text(found.unionByName(found.withColumn("title", F.lit("z"))), checks.scores(p, found), most=1)
    assert "SOURCE_CONCENTRATION" in t and "... and 1 more" in t
    assert rows(report.totals(found)) == [("major", 1, 1)]
    with pytest.raises(ValueError):
        files.adapter("unheard")
    assert files.adapter("local") is files.scan
