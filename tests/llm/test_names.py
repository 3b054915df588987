import random
from itertools import combinations

from citeloom.llm import names as N


def clusters(spark, names):
    df = spark.createDataFrame([(n, n) for n in names], "name string, cluster string")
    out = {}
    for r in N.link_names(df).collect():
        out.setdefault(r.cluster, set()).add(r.name)
    return sorted(map(frozenset, out.values()), key=sorted)


def test_parse_and_nobody():
    assert N.parse("Prof. Sandstrom, Ann B")[1:3] == (["ann", "sandstrom"], ["b"])
    assert N.parse("LIZ SANDSTRÖM")[1] == ["elizabeth", "sandstrom"]
    assert N.parse("Wexford Inst. for Tidal Law")[:2] == ("org", ["institute", "law", "tidal", "wexford"])
    for nobody in (None, "", "  ", "Staff", "However", "et al", "NA", "??", "No cite", "cut from a packet, ask someone", '("A title", Journal', "[cite omitted"):
        assert N.parse(nobody) is None


def test_one_edit():
    assert all(N.one_edit(a, b) for a, b in (("abcd", "abdc"), ("abcd", "abd"), ("abcd", "abxd"), ("abcd", "abbcd"), ("a", "a")))
    assert not N.one_edit("abcd", "badc") and not N.one_edit("abcd", "ab")


def test_average_linkage_weights():
    assert N.average_linkage(3, {(0, 1): 1.0, (1, 2): 1.0}, 0.6) == [0, 0, 2]
    assert N.average_linkage(3, {(0, 1): 0.9, (0, 2): 0.9}, 0.5, [3.0, 1.0, 1.0]) == [0, 0, 0]


def test_links_variants_and_keeps_others_apart(spark):
    ann = ["Elizabeth Sandstrom", "Sandstrom, Elizabeth", "Dr. Elizabeth Sandstrom", "Liz Sandstrom", "E. Sandstrom", "Elizabeth Q. Sandstrom", "ELIZABETH SANDSTROM", "Sandstrom Elizabeth", "Elizabeth Sandström", "Elizabeth Sandstorm", "Sandstrom"]
    bob = ["Robert Calloway", "Bob Calloway", "Calloway, Robert"]
    org = ["Wexford Institute for Tidal Law", "The Wexford Institute for Tidal Law", "Wexford Inst. for Tidal Law", "Wexford Tidal Law Institute", "Tidal Law Institute, Wexford", "WIfTL", "Wexford Institute for Tidal Lwa"]
    nobody = ["Staff", "However", "NA", "", None, "et al", "No cite"]
    got = clusters(spark, [*ann, *bob, *org, *nobody, "Thomas Merriwether", *ann])
    assert got == sorted([frozenset(ann), frozenset(bob), frozenset(org)], key=sorted)


def test_ambiguous_part_stays_alone(spark):
    got = clusters(spark, ["Ann Calloway", "Calloway, Ann", "Robert Calloway", "Calloway, Robert", "Calloway", "A. Calloway"])
    assert frozenset({"Ann Calloway", "Calloway, Ann", "A. Calloway"}) in got and not any("Calloway" in c for c in got)


def test_empty_and_heads(spark):
    empty = spark.createDataFrame([], "name string")
    assert N.link_names(empty).count() == 0
    cards = spark.createDataFrame([(None, "Ann Calloway, '12 (x)"), ("As stored ", "y"), (None, None), (None, " 2012 x")], "cite_author string, cite_raw string")
    assert {r.name for r in N.card_spellings(cards).collect()} == {"Ann Calloway", "As stored ", ""}


def test_large_component_keeps_sure_links(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_PAIRS", 1)
    got = clusters(spark, ["Ann Calloway", "Calloway, Ann", "Ann B. Calloway", "Ann Callowya", "Ann Calowlay"])
    # one swap is one error, whatever other misspellings make its n-grams frequent; Calowlay is two away from each
    assert frozenset({"Ann Calloway", "Calloway, Ann", "Ann B. Calloway", "Ann Callowya"}) in got


def test_large_component_is_clustered_as_a_small_one(spark, monkeypatch):
    rng = random.Random(5)
    people = [f"{g} {i}{s}" for g in ("Ann", "Annabel") for i in ("", "B. ", "C. ", "Q. ", "B. C. ") for s in ("Calloway", "Callowya", "Caloway", "Callowey")]
    score = {p: rng.choice((0.9, 1.0)) for p in combinations(people, 2) if rng.random() < 0.15}
    n = {p: rng.randrange(1, 5) for p in people}
    # a star: one name is close to most, of which few are close to each other
    score |= {("Ann Hub", p): 1.0 for p in people[:30]}
    n["Ann Hub"] = 4
    pairs = spark.createDataFrame([(*sorted(p), s, n[min(p)], n[max(p)]) for p, s in score.items()], "a string, b string, score double, na bigint, nb bigint")
    whole = {(r.name, r.cluster) for r in N._cluster(pairs, 0.35).collect()}
    own = sorted(n)
    at = {p: i for i, p in enumerate(own)}
    plain = naive_linkage(len(own), {tuple(sorted((at[a], at[b]))): round(10 * s) for (a, b), s in score.items()}, 3.5, [n[p] for p in own])
    assert whole == {(p, own[plain[i]]) for i, p in enumerate(own)} and 1 < len(set(plain)) < len(own)
    for most in (1, 100):
        monkeypatch.setattr(N, "MOST_PAIRS", most)
        assert {(r.name, r.cluster) for r in N._cluster(pairs, 0.35).collect()} == whole


def naive_linkage(n, scores, least, mass):
    own = {i: [i] for i in range(n)}
    while True:
        best = None
        for i, j in combinations(sorted(own), 2):
            mean = sum(scores.get((min(x, y), max(x, y)), 0) * mass[x] * mass[y] for x in own[i] for y in own[j]) / (sum(mass[x] for x in own[i]) * sum(mass[y] for y in own[j]))
            if mean >= least and (best is None or mean > best[0]):
                best = mean, i, j
        if best is None:
            return [next(c for c, m in own.items() if i in m) for i in range(n)]
        own[best[1]] += own.pop(best[2])


def test_large_component_keeps_typing_errors(spark, monkeypatch):
    names = ["Ann Calloway", "Calloway, Ann", "Ann B. Calloway", "Ann Callowya"]
    monkeypatch.setattr(N, "MOST_PAIRS", 1)
    assert clusters(spark, names) == [frozenset(names)]


def test_typing_errors_of_a_frequent_author(spark):
    right = ["Ann Calloway", "Calloway, Ann", "Dr. Ann Calloway", "ANN CALLOWAY"]
    wrong = ["Ann Callowya", "Callowya, Ann", "Dr. Ann Callowya"]
    noke = ["Robert Nokemarsh", "Nokemarsh, Robert", "Dr. Robert Nokemarsh"]
    nose = ["Robert Nosemarsh", "Nosemarsh, Robert", "Dr. Robert Nosemarsh"]
    assert clusters(spark, [*right * 20, *wrong, *noke, *nose]) == sorted([frozenset(right + wrong), frozenset(noke), frozenset(nose)], key=sorted)


def test_frequent_parts_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_A_TASK", 3)  # lists and clusters are spread
    given = ["Ada", "Ben", "Cleo", "Dora", "Emil", "Fay", "Gus", "Hugo", "Ida", "Jon", "Kim", "Leo", "Mona", "Nils", "Olga", "Paul"]
    names = [f"{g} Smithson" for g in given] + ["Zebulon Smithson", "Z. Smithson", "Smithson, Zebulon", "Zebulno Smithson", "Zebulon Smihtson", "Zebulon Q. Smithson"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, cluster int").select("name")
    got = {frozenset((r.name_a, r.name_b)) for r in N.name_pairs(N.link_names(df)).collect()}
    one = names[len(given) :]
    assert got == {frozenset((a, b)) for i, a in enumerate(one) for b in one[i + 1 :]}


def test_top_n_and_exact_join(spark):
    names = ["Ministry of River Law", "Ministry of River Laws", "Ministry of River Lawn", "Ministry for River Law", "Institute of Bread Studies"]
    forms = N.parsed_spellings(spark.createDataFrame([(n,) for n in names], "name string")).select("kind", "parts", "grams", "name")
    vec = N.name_vectors(forms)
    exact = N.with_cosine(N.prefix_pairs(vec, 0.4), vec, 0.4).collect()
    v = {r.id: {x["g"]: x["w"] for x in r.v} for r in vec.collect()}
    want = {(a, b): sum(w * v[b].get(g, 0.0) for g, w in v[a].items()) for a in v for b in v if a < b}
    assert {(r.a, r.b) for r in exact} == {k for k, c in want.items() if c >= 0.4} and all(abs(r.cosine - want[r.a, r.b]) < 1e-9 for r in exact)
    near = {(r.a, r.b) for r in N.with_cosine(N.prefix_pairs(vec, 0.4), vec, 0.4, top=1).collect()}
    best = {max(((c, tuple(sorted((a, b)))) for (a, b), c in want.items() if x in (a, b) and c >= 0.4), default=None) for x in v}
    assert near == {p for _, p in best - {None}} and near < {(r.a, r.b) for r in exact}
