import random

from citeloom.llm import consensus as C
from citeloom.llm.components import connected_components


def groups(df):
    return {r.node_id: r.group_id for r in df.collect()}


def test_chain_cycle_and_dirty_pairs(spark):
    rows = [("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("x", "y"), (None, "q"), ("q", None), ("z", "z")]
    df = spark.createDataFrame([(a, b, 1, "n") for a, b in rows], "s string, t string, n int, group_id string")
    assert groups(connected_components(df, "s", "t")) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_empty(spark):
    df = spark.createDataFrame([], "s string, t string")
    out = connected_components(df, "s", "t")
    assert out.count() == 0 and out.columns == ["node_id", "group_id"]


def test_random_graph_and_hub_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"{rng.randrange(400):04d}", f"{rng.randrange(400):04d}") for _ in range(260)] + [("hub0", f"leaf{i}") for i in range(300)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = groups(connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b"))
    assert got == {x: find(x) for x in parent}


def test_statements_of_lines():
    full = 'Dr. Ann Example \'19 (senior fellow in law, "A Quoted Title", Journal of Things, 3/4/19, https://read.where.example/1) //tm'
    assert set(C.state(full)) == set(C.COMPONENTS)
    assert set(C.state("N. Person, 08 [lead analyst; “Some title words”; The Paper; 1/2/08]")) == {"author", "year", "qualification", "title", "publication"}
    assert set(C.state("Some Institute for Things 2010 -- “Title of it”. Policy Notes. staff economist. https://a.b/c. 1/1/10")) == set(C.COMPONENTS)
    for nothing in (None, "", "   ", "NA", "No cite", "??", "cut from a packet, ask second speaker", "Same cite as above, recut after the tournament; brackets were added by the team"):
        assert C.state(nothing) == {}
    assert set(C.state("Ann Example 2001 *bracketed for clarity, breaks removed by the team*")) == {"author", "year"}


def test_alignment_votes_and_keeps_what_any_line_states():
    a = [{"annals": 1.0}, {"of": 1.0}, {"reform": 1.0}]
    b = [{"annals": 2.0}, {"reform": 2.0}]
    merged = C.align(a, b)
    assert [max(c, key=c.get) for c in merged] == ["annals", "of", "reform"] and merged[0]["annals"] == 3.0
    p = C.merge_profiles({"author": a}, {"url": b})
    assert set(C.consensus_of(p)) == {"author", "url"}


def test_best_records(spark):
    schema = "card_id string, read_ratio double, cite_raw string, disclosed_only boolean, group_id string, text string"
    rows = [
        ("a", 0.5, "Ann Example 2001", True, "clash", "x"), ("b", 0.3, "Ann Example 2001 (lead analyst)", False, None, None), ("c", 0.9, "NA", False, None, None), ("c", 0.9, "NA", False, None, None),
        ("d", float("nan"), None, None, None, None), ("e", 0.95, None, False, None, None), ("f", None, "", False, None, None), ("lone", 0.5, "Ann Example 2001", False, None, None),
    ]
    cards = spark.createDataFrame(rows, schema)
    g = spark.createDataFrame([(x, "a") for x in "abcd"] + [("e", "e"), ("f", "e"), ("lone", "lone"), ("gone", "lone")], "node_id string, group_id string")
    got = {r.group_id: (r.card_id, r.cite_card_id) for r in C.best_records(cards, g).collect()}
    # c: not only disclosed and the higher ratio within bounds; b states most; in e's group no ratio counts and nobody states anything
    assert got == {"a": ("c", "b"), "e": ("e", "e")}
    assert C.best_records(cards.limit(0), g).count() == 0


def test_large_group_is_aligned_in_chunks(spark):
    rows = [(f"c{i:04d}", 0.5, f"Ann Example{i} 20{i % 20:02d}" + (" (lead analyst, https://a.b/c)" if i == 333 else ""), False) for i in range(400)]
    cards = spark.createDataFrame(rows, "card_id string, read_ratio double, cite_raw string, disclosed_only boolean")
    g = cards.selectExpr("card_id node_id", "'c0000' group_id")
    r = C.best_records(cards, g).collect()
    assert len(r) == 1 and r[0].cite_card_id == "c0333" and r[0].card_id == "c0000"


def test_consensus_decides_what_a_line_states(spark):
    free = "Ann Example 2001, in the annals of river law, https://a.b/c"  # no grammar tells that publication
    rows = [
        ("a", 0.5, "Ann Example 2001, https://a.b/c", False), ("b", 0.5, "Ann Example 2001 (Annals of River Law)", False), ("c", 0.5, "Ann Example (Annals of River Law)", False),
        ("d", 0.5, "Example 01 (Annals of River Law)", False), ("e", 0.5, free, False),
    ]
    cards = spark.createDataFrame(rows, "card_id string, read_ratio double, cite_raw string, disclosed_only boolean")
    assert [r.cite_card_id for r in C.best_records(cards, cards.selectExpr("card_id node_id", "'a' group_id")).collect()] == ["e"]
    # without the group's votes it states no more than the smaller id
    voted = {"publication": ["Annals", "of", "River", "Law"]}
    assert C.stated_with(free, {}) == set(C.state(free)) == {"author", "year", "url"} and C.stated_with(free, voted) == {"author", "year", "url", "publication"}
    assert C.stated_with(None, voted) == set()
    assert "publication" not in C.stated_with("Annals River 2001", voted)  # tokens of another component count there alone
