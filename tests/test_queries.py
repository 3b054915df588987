"""Registered core queries against their SQL, on the driver's smallest tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

from citeloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    catalog.queries()[name](spark, DATA).collect()


def test_core_does_not_need_llm():
    import re

    root = Path(__file__).resolve().parents[1] / "citeloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+citeloom\.llm", f.read_text(), re.M), f


def test_views_and_commands(spark, tmp_path, capsys):
    from citeloom import views
    from citeloom.__main__ import main

    assert {"cards", "card_flags"} <= set(views.register(spark, DATA))
    assert spark.sql("SELECT count(*) FROM card_flags WHERE array_contains(flags, 'undated')").first()[0] > 0
    assert main(["stats", DATA], spark) == 0 and main(["search", DATA, "carbon sinks", "-k", "2", "--side", "aff"], spark) == 0
    report = tmp_path / "r.json"
    assert main(["analyze", DATA, "--report", str(report)], spark) == 0 and report.read_text().startswith("[")
    card = spark.table("cards").select("card_id").first()[0]
    assert main(["packet", DATA, str(tmp_path / "p.zip"), card], spark) == 0
    assert main(["bundle-export", DATA, str(tmp_path / "b.zip")], spark) == 0 and main(["bundle-inspect", str(tmp_path / "b.zip")]) == 0
    assert main(["bundle-import", str(tmp_path / "b.zip"), str(tmp_path / "out")], spark) == 0
    assert main(["graph", DATA, str(tmp_path / "g")], spark) == 0 and spark.read.parquet(str(tmp_path / "g" / "answers")).count() > 0
    for bad in (["search", DATA, "x", "-k", "0"], ["search", DATA, "x", "--year-min", "2020", "--year-max", "2010"], ["unheard"]):
        with pytest.raises(SystemExit):
            main(bad, spark)


def test_tfidf_topk_asks_for_every_stated_card(spark, monkeypatch):
    from citeloom.operators import retrieval

    ids = {r.card_id for r in spark.read.parquet(f"{DATA}/cards.parquet").select("card_id").distinct().collect()}
    stated = {i for i in ids if int(i, 16) % 20 == 0}
    rows = catalog.queries()["tfidf_topk"](spark, DATA).collect()
    assert len(stated) > 1 and {r.q for r in rows} == stated and all(r.q != r.card_id and r.rank <= 25 for r in rows)
    monkeypatch.setattr(retrieval, "QUERIES_A_TASK", 2)
    assert sorted((r.q, r.rank, r.score) for r in catalog.queries()["tfidf_topk"](spark, DATA).collect()) == sorted((r.q, r.rank, r.score) for r in rows)
