"""Variant spellings of people and organisations.

Distinct spellings become weighted character n-gram vectors, and a sparse join yields the
pairs whose cosine reaches a threshold, all of them or the top n per spelling: organisations
are joined on their n-grams by prefix filter; of people's names the words are, and names meet
on a near word and all their other parts, so that a frequent surname pairs nobody who has only
that in common.  Pairs are then verified part by part (same parts in any order, nicknames,
initials, one typing error).  Their score, half of which is the cosine, is what verified pairs
are grouped by: average-linkage clustering inside their connected components.  Spellings
that state only part of a name (a surname, initials, an acronym) join a cluster when just
one fits them.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty
from citeloom.llm.components import connected_components
from citeloom.skew import lookup_join
from citeloom.staging import drop_staged, stage

#: Short forms of given names (fixed values of common English usage).
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "sasha": "alexander", "andy": "andrew", "tony": "anthony", "art": "arthur", "barb": "barbara",
    "ben": "benjamin", "bella": "isabella", "becky": "rebecca", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth",
    "bill": "william", "billy": "william", "will": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "brad": "bradley", "cathy": "catherine",
    "charlie": "charles", "chuck": "charles", "chris": "christopher", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah",
    "debbie": "deborah", "dick": "richard", "rick": "richard", "rich": "richard", "don": "donald", "ed": "edward", "eddie": "edward", "etta": "henrietta",
    "fred": "frederick", "freddy": "frederick", "gabe": "gabriel", "gene": "eugene", "greg": "gregory", "hank": "henry", "harry": "henry", "inga": "ingeborg",
    "jack": "john", "johnny": "john", "jackie": "jacqueline", "jake": "jacob", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james",
    "jimmy": "james", "jo": "josephine", "josie": "josephine", "joe": "joseph", "jon": "jonathan", "kate": "katherine", "katie": "katherine", "kathy": "katherine",
    "kit": "christopher", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "leo": "leonard", "lou": "louis", "maggie": "margaret", "meg": "margaret",
    "peggy": "margaret", "matt": "matthew", "max": "maximilian", "mike": "michael", "mo": "mohammed", "mohamed": "mohammed", "muhammad": "mohammed", "nate": "nathaniel",
    "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas", "pat": "patricia", "patty": "patricia", "pete": "peter", "phil": "philip",
    "ray": "raymond", "ron": "ronald", "russ": "russell", "sally": "sarah", "sam": "samuel", "sandy": "sandra", "steve": "steven", "sue": "susanna",
    "susie": "susanna", "ted": "theodore", "thea": "theodora", "dora": "theodora", "tim": "timothy", "tina": "christina", "tom": "thomas", "tommy": "thomas",
    "trish": "patricia", "val": "valerie", "vic": "victor", "vicky": "victoria", "vickie": "victoria", "vince": "vincent", "vinny": "vincent", "walt": "walter",
    "wendy": "gwendolyn", "yoli": "yolanda", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
TITLES = frozenset("dr prof professor mr mrs ms sir hon rev judge sen rep gov lt col gen capt phd md jd esq jr sr ii iii iv et al and others".split())
#: Words that stand where a name should and name nobody.
NOBODY = frozenset(
    "a according additionally after all also although an and anon anonymous another any as at author authors because before both but by cite cited citation cites despite during each editor editors even every few finally first for from furthermore given he her here his how however if in indeed instead it its later many meanwhile moreover most my n na nevertheless no nobody none not note now of on once one only or other our perhaps same second see she since so some staff still such tbd that the their then there therefore these they third this those though thus to today two unknown untitled until various we what when where whether which while who why with without writer yes yet you".split()
)
ORG_WORDS = {
    "inst": "institute", "instit": "institute", "fdn": "foundation", "found": "foundation", "ctr": "center", "cntr": "center", "centre": "center", "assn": "association",
    "assoc": "association", "univ": "university", "dept": "department", "natl": "national", "intl": "international", "soc": "society", "comm": "commission", "govt": "government",
    "obs": "observatory", "cncl": "council", "coll": "college", "acad": "academy", "bur": "bureau",
}
ORG_KINDS = frozenset(
    "institute foundation center association council observatory university department society commission agency bureau office college school academy ministry network coalition alliance forum group union league trust fund board committee project initiative program press".split()
)
LINK_WORDS = frozenset("for of the and in on".split())
_ACRONYM = re.compile(r"^(?=(?:[^A-Z]*[A-Z]){3})[A-Z][A-Za-z&]{1,8}[A-Z]$")

#: Cosine from which a pair of organisations is verified, and average score from which clusters merge.
COSINE, LINK = 0.40, 0.33
#: The same for people, whose parts already agree, and for parts of names before their letters are compared: less than a swap in a word of five letters leaves.
PEOPLE_COSINE, PART_COSINE = 0.12, 0.12
#: Spellings up to which a name may be another's typing error, however often it is given.
FEW_SPELLINGS = 2
#: Beyond, the largest share that its records or its spellings may be of the other's: what names one typing error apart have is measured in the README.
RARE_ROWS, RARE_SPELLINGS = 0.05, 0.4
#: Pairs of a component up to which it is clustered in one task.
MOST_PAIRS = 20_000
#: Scores are summed in these units.
UNITS = 100


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def head_spelling(author: str | None, raw: str | None) -> str | None:
    """The author as stored; where null, the raw cite before its first digit without blanks, commas and apostrophes at its ends."""
    return author if author is not None else None if raw is None else re.match(r"[^0-9]*", raw)[0].strip(" \t\r\n,'’")


def parse(name: str | None):
    """(kind, parts, initials, compact): kind is person, org, acronym or None for what names nobody.

    ``parts``: sorted canonical words of two or more letters; ``initials`` in order;
    ``compact``: the letters of the parts in the order written (organisations).
    """
    if not name or not name.strip() or not (name[0].isalpha()):
        return None
    if _ACRONYM.match(name.strip()) and not name.isupper():
        return "acronym", [fold(name.strip())], [], ""
    words = re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", name)
    low = [fold(w) for w in words]
    org = [spelled_out(w, f"{v}." in name) for w, v in zip(low, words)]
    if len(words) >= 3 and any(w in ORG_KINDS for w in org):
        core = [w for w in org if w not in LINK_WORDS]
        if len(core) <= 9 and sum(w[:1].isupper() for w in words) >= len(core) - 1:
            return "org", sorted(core), [], "".join(core)
    kept = [(w, f) for w, f in zip(words, low) if f not in TITLES]
    if not kept or len(kept) > 5 or any(f in NOBODY and len(f) > 1 for _, f in kept) or not all(w[0].isupper() for w, _ in kept):
        return None
    parts = sorted(NICKNAMES.get(f, f) for _, f in kept if len(f) > 1)
    initials = [f for _, f in kept if len(f) == 1]
    return ("person", parts, initials, "") if parts else None


def spelled_out(word: str, dotted: bool) -> str:
    """The word an abbreviation stands for: a listed one, or with a point the kind of organisation it shortens."""
    if word in ORG_WORDS:
        return ORG_WORDS[word]
    if dotted and len(word) >= 3:
        for kind in sorted(ORG_KINDS):
            rest = iter(kind)
            if kind[0] == word[0] and all(c in rest for c in word):
                return kind
    return word


def acronym_of(name: str) -> str:
    """First letters of all words, as acronyms are written (the leading article is not)."""
    words = re.findall(r"[^\W\d_]+", name)
    if words and words[0].lower() == "the":
        words = words[1:]
    return "".join(fold(ORG_WORDS.get(fold(w), w))[:1] for w in words)


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def grams(name: str, parsed) -> list[str]:
    """Character trigrams of the parts, with marked ends; organisations also have their acronym."""
    kind, parts, _, _ = parsed
    if kind == "acronym":
        return ["=" + parts[0]] * 3
    out = [f"^{p}$"[i : i + 3] for p in parts for i in range(len(p))]
    return out + ["=" + acronym_of(name)] * 3 if kind == "org" else out


def verify(a, b) -> tuple[float, str]:
    """Score and kind of agreement of two parsed spellings: same, typo, part or none (0)."""
    (ka, pa, ia, ca), (kb, pb, ib, cb) = a, b
    if "acronym" in (ka, kb):
        return (1.0, "same") if ka == kb and pa == pb else (0.0, "")
    if ka != kb:
        return 0.0, ""
    if ka == "org":
        if pa == pb:
            return 1.0, "same"
        if one_edit(ca, cb) or len(ca) >= 15 and sorted(ca) == sorted(cb) and 2 * len(set(pa) & set(pb)) >= min(len(pa), len(pb)):
            return 0.9, "typo"
        ra, rb = list(pa), list(pb)
        for w in pa:
            if w in rb:
                ra.remove(w)
                rb.remove(w)
        return (0.9, "typo") if len(ra) == len(rb) == 1 and min(len(ra[0]), len(rb[0])) >= 3 and one_edit(ra[0], rb[0]) else (0.0, "")
    if len(pa) > len(pb):
        (pa, ia), (pb, ib) = (pb, ib), (pa, ia)
    rest, typo = list(pb), 0
    for w in pa:
        hit = w if w in rest else next((x for x in rest if min(len(x), len(w)) >= 5 and one_edit(w, x)), None)
        if hit is None:
            return 0.0, ""
        typo += hit != w
        rest.remove(hit)
    if typo > 1:
        return 0.0, ""
    if len(pa) == len(pb):
        if len(pa) >= 2:
            if ia and ib and ia[0] != ib[0]:
                return 0.0, ""
        elif ia and ib and ia[0] != ib[0]:
            return 0.0, ""
        return (0.9, "typo") if typo else (1.0, "same")
    if len(pa) == 1 and ia and not any(x.startswith(ia[0]) for x in rest):
        return 0.0, ""
    return (0.6, "part-typo") if typo else (0.7, "part")


def average_linkage(n: int, scores: dict[tuple[int, int], float], least: float, weights: list[float] | None = None) -> list[int]:
    """Cluster numbers of ``n`` items: the closest two clusters merge while their mean score reaches ``least``.

    An item stands for ``weights`` spellings, over whose pairs the mean is taken.  Pairs
    without a score count 0.  Ties go to the smaller numbers.
    """
    mass = list(weights or [1.0] * n)
    return merge_closest({(i, j): s * mass[i] * mass[j] for (i, j), s in scores.items()}, mass, least)


def merge_closest(sums: dict[tuple[int, int], float], mass: list[float], least: float, fixed: frozenset[int] = frozenset()) -> list[int]:
    """Cluster numbers by average linkage of clusters with ``mass`` spellings and ``sums`` of scores between them.

    ``fixed`` ones are merged elsewhere, so their present means bound those to come: whose
    closest partner is fixed stays as it is, and all merges done are merges of the whole.
    """
    mass, held = list(mass), set(fixed)
    members = {i: [i] for i in range(len(mass))}
    total: dict[int, dict[int, float]] = {i: {} for i in members}
    for (i, j), s in sums.items():
        total[i][j] = total[j][i] = s

    def entry(i, j):
        return -total[i][j] / (mass[i] * mass[j]), min(i, j), max(i, j)

    heap = [e for e in (entry(i, j) for i, j in sums) if -e[0] >= least]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        _, i, j = top
        if j not in total.get(i, ()) or entry(i, j) != top:
            continue
        if i in held or j in held:
            held |= {i, j}
            continue
        members[i] += members.pop(j)
        mass[i] += mass[j]
        for k, s in total.pop(j).items():
            del total[k][j]
            if k != i:
                total[i][k] = total[k][i] = total[i].get(k, 0) + s
        for k in total[i]:
            e = entry(i, k)
            if -e[0] >= least:
                heapq.heappush(heap, e)
    out = [0] * len(mass)
    for c, own in members.items():
        for i in own:
            out[i] = c
    return out


_PARSED = "name string, rows bigint, form string, kind string, parts array<string>, initials array<string>, compact string, grams array<string>"


def parsed_spellings(names: DataFrame) -> DataFrame:
    """One row per distinct spelling that names somebody; ``form`` is equal where the parts and initials are.

    ``rows``: the sum of that column of ``names``, without one the rows that have the spelling.
    """

    @nonempty
    def run(batches):
        for pdf in batches:
            rows = []
            for n, k in zip(pdf["name"], pdf["rows"]):
                p = parse(n)
                if p:
                    form = "|".join((p[0], " ".join(p[1]), " ".join(p[2])))
                    rows.append((n, k, form, *p, grams(n, p)))
            yield pd.DataFrame(rows, columns=["name", "rows", "form", "kind", "parts", "initials", "compact", "grams"])

    rows = F.sum("rows") if "rows" in names.columns else F.count("*")
    return names.where("name is not null").groupBy("name").agg(rows.alias("rows")).mapInPandas(run, _PARSED)


def erroneous(s1: str, s2: str, r1: str, r2: str) -> Column:
    """Whether the rarer of two names one typing error apart may be the other's error, by their spellings and records.

    A name with hardly any spelling may; others by their share of the more frequent name,
    which stays as it is when there are ten times the records.
    """
    few = F.least(s1, s2) <= FEW_SPELLINGS
    return few | (F.least(r1, r2) <= RARE_ROWS * F.greatest(r1, r2)) | (F.least(s1, s2) <= RARE_SPELLINGS * F.greatest(s1, s2))


#: Vectors in a list that one task joins with the whole list.
LIST_A_TASK = 2_000


def name_vectors(forms: DataFrame) -> DataFrame:
    """(id, v, norm): weighted character n-gram vectors of all forms; v has entries (g, w), from rare to frequent, of length 1.

    Weights are count times the root of log(1 + N / document frequency).  Each part of a
    person's name is a vector of length 1 of its own, and a name is their sum: then names
    that share a surname are no less alike when it becomes frequent, and a surname is as
    like every name that has it.
    """
    marked = F.transform("parts", lambda p, i: F.transform(F.sequence(F.lit(1), F.length(p)), lambda k: F.struct(i.cast("int").alias("i"), F.substr(F.concat(F.lit("^"), p, F.lit("$")), k, F.lit(3)).alias("g"))))
    single = F.transform("grams", lambda g: F.struct(F.lit(0).alias("i"), g.alias("g")))
    each = forms.select(F.col("name").alias("id"), F.explode(F.when(F.col("kind") == "person", F.flatten(marked)).otherwise(single)).alias("x"))
    counts = stage(each.groupBy("id", "x.i", "x.g").agg(F.count("*").alias("tf")), "grams")
    n = forms.count()
    df = counts.groupBy("g").agg(F.count_distinct("id").alias("df"))
    weighted = lookup_join(counts, df, ["g"]).withColumn("w", F.col("tf") * F.sqrt(F.log(1 + F.lit(float(max(n, 1))) / F.col("df"))))
    length = weighted.groupBy("id", "i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    whole = weighted.join(length, ["id", "i"]).groupBy("id", "g").agg(F.sum(F.col("w") / F.col("length")).alias("w"), F.first("df").alias("df"))
    vec = whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "g", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return stage(vec.select("id", F.transform("v", lambda x: F.struct(x["g"].alias("g"), (x["w"] / F.col("norm")).alias("w"))).alias("v")), "vectors")


def prefix_pairs(vec: DataFrame, least: float, keep=None) -> DataFrame:
    """(a, b), a < b: all pairs of ``name_vectors`` whose cosine may reach ``least``: none is lost.

    Only the prefix of a vector beyond which less than ``least`` of its length is left is
    joined.  Vectors in a long list are dealt to several tasks, which have all of the list on
    the other side.  ``keep``: a condition on a and b that pairs must meet besides, tested
    before they are made distinct.
    """

    @nonempty
    def prefixes(batches):
        for pdf in batches:
            ids, gs = [], []
            for i, v in zip(pdf["id"], pdf["v"]):
                left = 1.0
                for x in v:
                    if left < least * least - 1e-9:
                        break
                    ids.append(i)
                    gs.append(x["g"])
                    left -= x["w"] ** 2
            yield pd.DataFrame({"id": ids, "g": gs})

    post = stage(vec.mapInPandas(prefixes, "id string, g string"), "postings")
    long = post.groupBy("g").agg(F.ceil(F.count("*") / LIST_A_TASK).cast("int").alias("salts")).where("salts > 1")
    post = stage(post.join(F.broadcast(long), "g", "left").withColumn("salts", F.coalesce("salts", F.lit(1))), "salted")  # at most (all postings / LIST_A_TASK) grams
    left = post.select(F.col("id").alias("a"), "g", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = post.select(F.col("id").alias("b"), "g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    cand = left.join(right, ["g", "salt"]).where("a < b")
    return (cand if keep is None else cand.where(keep)).select("a", "b").distinct()


def with_cosine(cand: DataFrame, vec: DataFrame, least: float, top: int | None = None) -> DataFrame:
    """(a, b, cosine) of candidate pairs (a, b) with cosine >= ``least``.

    ``top``: for each vector only its so many nearest ones (ties by id), a pair counts if
    either end has it among these.  None is the exact join, with all of them.
    """
    va = vec.select(F.col("id").alias("a"), F.map_from_entries("v").alias("va"))
    vb = vec.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate("vb", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at("va", x["g"]), F.lit(0.0)))
    out = lookup_join(lookup_join(cand, va, ["a"]), vb, ["b"]).select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= least - 1e-9)
    if top is None:
        return out
    out = stage(out, "cosines")
    ways = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    best = ways.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("k") <= top)
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return out.join(best, ["a", "b"])


def near_words(words: DataFrame) -> DataFrame:
    """(pa, pbs): the words, of column part, that are one typing error from each word, by the cosine of their n-grams; those from five letters on."""
    grams = F.transform(F.sequence(F.lit(1), F.length("part")), lambda k: F.substr(F.concat(F.lit("^"), F.col("part"), F.lit("$")), k, F.lit(3)))
    rows = words.where(F.length("part") >= 5).select(F.col("part").alias("name"), F.lit("word").alias("kind"), F.array("part").alias("parts"), grams.alias("grams"))
    vec = name_vectors(rows)
    # a swap of neighbours is two edits for levenshtein, which runs on the JVM
    cand = stage(prefix_pairs(vec, PART_COSINE, F.expr("abs(length(a) - length(b)) <= 1 and levenshtein(a, b, 2) >= 0")), "near")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(a, b)], dtype=bool)

    near = with_cosine(cand.where(close("a", "b")), vec, PART_COSINE)
    both = near.select(F.col("a").alias("pa"), F.col("b").alias("pb")).unionByName(near.select(F.col("b").alias("pa"), F.col("a").alias("pb")))
    return both.groupBy("pa").agg(F.array_sort(F.collect_set("pb")).alias("pbs"))


def people_pairs(forms: DataFrame) -> DataFrame:
    """(a, b), a < b: forms of people that agree in all parts but one, and in that one but for a typing error; a single part with every name that has it.

    No part is left out, however frequent: the other parts, taken together, are the key that
    names are joined on, and rows of a frequent part are spread.
    """
    people = forms.where("kind = 'person'").select("name", "parts")
    one = people.select("name", "parts", F.posexplode("parts").alias("at", "part"))
    rest = F.concat_ws(" ", F.filter("parts", lambda p, i: i != F.col("at")))
    one = stage(one.select("name", F.size("parts").alias("k"), "part", rest.alias("rest")), "name-parts")
    near = stage(near_words(one.select("part").distinct()), "near-words")
    turned = lookup_join(one, near.withColumnRenamed("pa", "part"), ["part"]).select("name", "k", "rest", F.explode("pbs").alias("part"))
    exact = one.select("name", "k", "rest", "part")
    ways = stage(exact.unionByName(turned), "ways")
    # forms of one key differ in their initials only, so there are few
    whole = one.where("k > 1").groupBy("k", "rest", "part").agg(F.collect_set("name").alias("others"))
    full = lookup_join(ways.where("k > 1"), whole, ["k", "rest", "part"])
    alone = one.where("k = 1").groupBy("part").agg(F.collect_set("name").alias("others"))
    some = lookup_join(ways, alone, ["part"])
    pairs = full.select("name", "others").unionByName(some.select("name", "others")).select("name", F.explode("others").alias("other")).where("name <> other")
    return pairs.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()


def _scored(pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    cols = ["kind", "parts", "initials", "compact"]
    a = parsed.select(F.col("name").alias("a"), *[F.col(c).alias("a_" + c) for c in cols])
    b = parsed.select(F.col("name").alias("b"), *[F.col(c).alias("b_" + c) for c in cols])

    @nonempty
    def run(batches):
        for pdf in batches:
            got = [verify((r.a_kind, list(r.a_parts), list(r.a_initials), r.a_compact), (r.b_kind, list(r.b_parts), list(r.b_initials), r.b_compact)) for r in pdf.itertuples(index=False)]
            # the cosine of the whole names takes half of the score
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "score": [g[0] * (0.5 + 0.5 * min(1.0, c)) for g, c in zip(got, pdf["cosine"])], "how": [g[1] for g in got]})
            yield out[out["score"] > 0]

    joined = lookup_join(lookup_join(pairs.select("a", "b", "cosine"), a, ["a"]), b, ["b"]).where("a_kind = b_kind or 'acronym' in (a_kind, b_kind)")
    return joined.mapInPandas(run, "a string, b string, score double, how string")


def _cluster(pairs: DataFrame, least: float) -> DataFrame:
    """(name, cluster) by average linkage inside the connected components of scored pairs.

    A component of more than ``MOST_PAIRS`` pairs is clustered in rounds of many tasks
    (``_merge_round``) until it has no more; the clusters are the same either way.
    """
    comp = connected_components(pairs, "a", "b")
    # whole units, so that sums and means don't depend on the order of addition
    least *= UNITS
    total = F.round(F.col("score") * UNITS).cast("bigint") * F.col("na") * F.col("nb")
    placed = pairs.join(comp.select(F.col("node_id").alias("a"), "group_id"), "a").select("group_id", "a", "b", total.alias("total"), "na", "nb")
    large = stage(placed.groupBy("group_id").count().where(F.col("count") > MOST_PAIRS).select("group_id"), "large")
    out = _merge_groups(placed.join(large, "group_id", "left_anti"), least)
    if large.isEmpty():
        return out
    edges = stage(placed.join(large, "group_id", "left_semi"), "large-pairs")
    labels = stage(edges.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("cluster", F.col("name")), "large-labels")
    while True:
        size = edges.groupBy("group_id").agg(F.count("*").alias("k"), F.max(_mean("total", "na", "nb")).alias("best"))
        size = stage(size.where(F.col("best") >= least), "large-sizes")
        if size.isEmpty():
            return out.unionByName(labels)
        last = edges.join(size.where(F.col("k") <= MOST_PAIRS), "group_id", "left_semi")
        more = stage(edges.join(size.where(F.col("k") > MOST_PAIRS), "group_id", "left_semi"), "large-open")
        moved = stage(_merge_round(more, least), "large-moved")
        steps = moved.select("name", "cluster").unionByName(_merge_groups(last, least))
        new = lookup_join(labels.withColumnRenamed("name", "own"), steps.select(F.col("name").alias("cluster"), F.col("cluster").alias("to")), ["cluster"], "left")
        new = stage(new.select(F.col("own").alias("name"), F.coalesce("to", "cluster").alias("cluster")), "large-labels")
        ends = more
        for c in "ab":
            ends = lookup_join(ends, moved.select(F.col("name").alias(c), F.col("cluster").alias("c" + c), F.col("mass").alias("m" + c)), [c], "left")
        ends = ends.select("group_id", *[F.coalesce("c" + c, c).alias(c) for c in "ab"], "total", *[F.coalesce("m" + c, "n" + c).alias("n" + c) for c in "ab"]).where("a <> b")
        turned = F.col("a") > F.col("b")
        ends = ends.select("group_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        nxt = stage(ends.groupBy("group_id", "a", "b").agg(F.sum("total").alias("total"), F.first("na").alias("na"), F.first("nb").alias("nb")), "large-pairs")
        for t in (edges, labels, size, more, moved):
            drop_staged(t)
        edges, labels = nxt, new


def _mean(total: str, na: str, nb: str) -> Column:
    return F.col(total).cast("double") / (F.col(na) * F.col(nb))


def _merge_groups(edges: DataFrame, least: float) -> DataFrame:
    """(name, cluster): average linkage of each group in one task."""
    rows = edges.groupBy("group_id").agg(F.collect_list(F.struct("a", "b", "total", "na", "nb")).alias("p"))

    @nonempty
    def run(batches):
        for pdf in batches:
            names, clusters = [], []
            for p in pdf["p"]:
                count = {x["a"]: int(x["na"]) for x in p} | {x["b"]: int(x["nb"]) for x in p}
                own = sorted(count)
                at = {n: i for i, n in enumerate(own)}
                got = merge_closest({(at[x["a"]], at[x["b"]]): int(x["total"]) for x in p}, [count[n] for n in own], least)
                names += own
                clusters += [own[c] for c in got]
            yield pd.DataFrame({"name": names, "cluster": clusters})

    return rows.mapInPandas(run, "name string, cluster string")


def _merge_round(edges: DataFrame, least: float) -> DataFrame:
    """(name, cluster, mass) of clusters that some merges of the average linkage change.

    Two clusters that are each other's closest, and those whose closest partner is one of
    the two, make a block.  A task has all pairs of a block's clusters, with those outside
    held fixed; a block takes its closest clusters until they have ``MOST_PAIRS`` pairs.
    """
    pairs = edges.select("a", "b", (-_mean("total", "na", "nb")).alias("m"))
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("w"), F.struct("m", "a", "b").alias("s"))
    best = ways.groupBy("w.node").agg(F.min(F.struct("s", "w.other")).alias("x"), F.count("*").alias("degree"))
    best = stage(best.where(F.col("x.s.m") <= -least).select("node", F.col("x.other").alias("other"), F.col("x.s").alias("s"), "degree"), "closest")
    # pairs of mutual closest clusters have the same best pair
    roots = best.groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("root"), F.collect_list("node").alias("ends")).where("k = 2")
    roots = stage(roots.select("root", F.explode("ends").alias("node")), "mutual")
    leaves = lookup_join(best.join(roots, "node", "left_anti").withColumnRenamed("node", "leaf"), roots.withColumnRenamed("node", "other"), ["other"])
    reach = F.sum("degree").over(Window.partitionBy("root").orderBy("s", "leaf").rowsBetween(Window.unboundedPreceding, 0))
    leaves = leaves.withColumn("reach", reach).where(F.col("reach") <= MOST_PAIRS).select("root", F.col("leaf").alias("node"))
    block = stage(roots.unionByName(leaves), "blocks")
    rows = edges
    for c in "ab":
        rows = lookup_join(rows, block.select(F.col("node").alias(c), F.col("root").alias("r" + c)), [c], "left")
    rows = rows.withColumn("root", F.explode(F.array_distinct(F.filter(F.array("ra", "rb"), lambda r: r.isNotNull()))))
    rows = rows.select("root", "a", "b", "total", "na", "nb", F.coalesce(F.col("ra") == F.col("root"), F.lit(False)).alias("ia"), F.coalesce(F.col("rb") == F.col("root"), F.lit(False)).alias("ib"))

    def run(pdf):
        own = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {n: i for i, n in enumerate(own)}
        mass, fixed = [0] * len(own), set(range(len(own)))
        sums = {}
        for a, b, total, na, nb, ia, ib in zip(*(pdf[c].tolist() for c in ("a", "b", "total", "na", "nb", "ia", "ib"))):
            i, j = at[a], at[b]
            sums[i, j] = total
            mass[i], mass[j] = na, nb
            fixed -= {k for k, inside in ((i, ia), (j, ib)) if inside}
        got = merge_closest(sums, mass, least, frozenset(fixed))
        whole: dict[int, int] = {}
        for i, c in enumerate(got):
            whole[c] = whole.get(c, 0) + mass[i]
        rows = [(own[i], own[c], whole[c]) for i, c in enumerate(got) if whole[c] != mass[i]]
        return pd.DataFrame(rows, columns=["name", "cluster", "mass"])

    return rows.groupBy("root").applyInPandas(run, "name string, cluster string, mass bigint")


def link_names(names: DataFrame, cosine: float = COSINE, link: float = LINK, top: int | None = None) -> DataFrame:
    """(name, cluster) for every spelling that is linked to another one.

    ``top``: nearest vectors that are looked at per form; None looks at all that reach the
    threshold, which is the exact way.
    ``names`` has a column name, and may have the number of records as rows; null, blank
    and repeated spellings, and words that name nobody, are left out.  No spelling at all
    gives an empty table.
    """
    spelled = stage(parsed_spellings(names), "spellings")
    # spellings with the same parts and initials are one form, and forms are what is compared
    own = ["kind", "parts", "initials", "compact", "grams"]
    parsed = stage(spelled.groupBy("form").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in own]).withColumnRenamed("form", "name"), "forms")
    vec = name_vectors(parsed)
    others = vec.join(parsed.where("kind <> 'person'").select(F.col("name").alias("id")), "id", "left_semi")
    near = with_cosine(stage(prefix_pairs(others, cosine), "org-pairs"), vec, cosine, top)
    near = near.unionByName(with_cosine(stage(people_pairs(parsed), "people-pairs"), vec, PEOPLE_COSINE, top))
    pairs = stage(_scored(near, parsed), "name-pairs")
    # a typing error is a rare spelling of an established name: of two established names neither is the other's error
    key = F.concat_ws(" ", "kind", F.array_join("parts", " "))
    support = spelled.groupBy(key.alias("key")).agg(F.count("*").alias("support"), F.sum("rows").alias("records"))
    whole = (F.col("kind") == "org") | ((F.col("kind") == "person") & (F.size("parts") >= 2))
    info = stage(parsed.select("name", "kind", whole.alias("whole"), key.alias("key"), F.col("parts")[0].alias("part"), F.size("initials").alias("n_initials"), "n").join(support, "key"), "name-info")
    ia = info.select(F.col("name").alias("a"), F.col("whole").alias("wa"), F.col("support").alias("sa"), F.col("records").alias("ra"), F.col("n").alias("na"))
    ib = info.select(F.col("name").alias("b"), F.col("whole").alias("wb"), F.col("support").alias("sb"), F.col("records").alias("rb"), F.col("n").alias("nb"))
    known = stage(pairs.join(ia, "a").join(ib, "b"), "name-known")
    linked = (F.col("how") == "same") | ((F.col("how") == "typo") & erroneous("sa", "sb", "ra", "rb"))
    strong = known.where("wa and wb").where(linked).select("a", "b", "score", "na", "nb")
    clusters = _cluster(stage(strong, "strong"), link)
    alone = info.where("whole").select("name").join(clusters, "name", "left_anti").select("name", F.col("name").alias("cluster"))
    clusters = stage(clusters.unionByName(alone), "clusters")
    # spellings that state a part of a name: one fitting cluster takes them
    parts = known.where("wa <> wb and how like 'part%'")
    fits = parts.select(F.when(F.col("wa"), F.col("b")).otherwise(F.col("a")).alias("part_name"), F.when(F.col("wa"), F.col("a")).otherwise(F.col("b")).alias("name"), (F.col("how") == "part").alias("exact"))
    acronyms = info.where("kind = 'acronym'").select(F.col("name").alias("part_name"), F.col("part").alias("acr"))
    full = spelled.where("kind = 'org'").select(F.col("form").alias("name"), F.explode(F.array_distinct(F.filter("grams", lambda g: g.startswith("=")))).alias("g")).select("name", F.substring("g", 2, 99).alias("acr")).distinct()
    fits = fits.unionByName(acronyms.join(full, "acr").select("part_name", "name", F.lit(True).alias("exact")))
    per = fits.join(clusters, "name").groupBy("part_name").agg(F.collect_set(F.when(F.col("exact"), F.col("cluster"))).alias("e"), F.collect_set("cluster").alias("t"))
    choice = F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("t"))
    taken = per.select(F.col("part_name").alias("name"), choice.alias("c")).where(F.size("c") == 1).select("name", F.col("c")[0].alias("cluster"))
    taken = stage(taken, "taken")
    # parts that no cluster takes are grouped among themselves
    open_parts = info.where("not whole").select("name").join(per.select(F.col("part_name").alias("name")), "name", "left_anti")
    rest = known.where("not wa and not wb").where(linked).select("a", "b", "score", "na", "nb")
    rest = rest.join(open_parts.select(F.col("name").alias("a")), "a").join(open_parts.select(F.col("name").alias("b")), "b")
    grouped = _cluster(stage(rest, "rest"), link)
    out = clusters.unionByName(taken).unionByName(grouped)
    loose = parsed.select("name").join(out, "name", "left_anti").select("name", F.col("name").alias("cluster"))
    out = spelled.select("name", "form").join(out.unionByName(loose).withColumnRenamed("name", "form"), "form").select("name", "cluster")
    size = out.groupBy("cluster").agg(F.count("*").alias("k"))
    return out.join(size.where("k > 1"), "cluster").select("name", "cluster")


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: every two spellings of one cluster; members of a large one are dealt to several tasks."""
    salts = linked.groupBy("cluster").agg(F.ceil(F.count("*") / LIST_A_TASK).cast("int").alias("salts")).where("salts > 1")
    rows = linked.join(F.broadcast(salts), "cluster", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))  # at most (all spellings / LIST_A_TASK) clusters
    mine = rows.select(F.col("name").alias("name_a"), "cluster", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int").alias("salt"))
    other = rows.select(F.col("name").alias("name_b"), "cluster", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return mine.join(other, ["cluster", "salt"]).where("name_a < name_b").select("name_a", "name_b")


def card_spellings(cards: DataFrame) -> DataFrame:
    """Distinct column name: the author as stored, else the head of the raw cite (see ``head_spelling``); rows: how often."""
    head = F.regexp_replace(F.regexp_extract("cite_raw", r"^([^0-9]*)", 1), r"^[\s,'’]+|[\s,'’]+$", "")
    return cards.select(F.coalesce("cite_author", head).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("rows"))
