"""Column functions over titles, cites, authors and evidence text.

Everything is built from Spark's own expressions.  Nulls give null unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content in titles, prefixes of answers and speeches, and side markers.
TITLE_STOP = (
    "the", "a", "an", "of", "and", "to", "for", "on", "in", "at", "da", "cp", "adv", "advantage", "block", "answers", "ans", "frontline", "ext",
    "extension", "1nc", "2nc", "1nr", "2nr", "1ac", "2ac", "1ar", "2ar",
)
ANSWER_PREFIX = r"^(?:a[/\\]?t:?\s+|at\s+the\s+|answers?\s+to:?\s+|ans\s+|2ac\s+at:?\s+|1ar\s+at:?\s+|-{0,2}\s*at\s*-{0,2}\s+)"
SPEECH_PREFIX = r"^(?:2ac|1ar|2ar|1nc|2nc|1nr|block|overview|ov)\b[\s:—-]*"
AFF_MARKS = r"\b(1ac|2ac|1ar|2ar|aff|affirmative|advantage)\b"
NEG_MARKS = r"\b(1nc|2nc|1nr|2nr|neg|negative|da|disad|cp|counterplan|kritik|k)\b"
# Hedges, strong claims and qualifications of evidence.
FLAG_HEDGE = r"\b(may|might|could|suggests?|appears?|possibly|potentially|is likely to|we estimate|projected)\b"
FLAG_STRONG = r"\b(collapse[sd]?|causes?|guarantees?|ensures?|proves?|destroys?|extinction|inevitable|will)\b"
STRONG_CLAIM = (
    r"\b(collapse[sd]?|collapsing|causes?|caused|guarantees?|ensures?|proves?|destroys?|devastat\w+|extinction|inevitab\w+|necessar\w+|only way|"
    r"eliminat\w+|solves?|reverses?|triggers?|forces?)\b"
)
HEDGE = (
    r"\b(may|might|could|possibly|potentially|suggests?|appears?|seems?|is likely|are likely|we estimate|projected|assum\w+|if current trends|"
    r"under some scenarios|preliminary)\b"
)
QUALIFICATION = r"(prof(essor)?\b|ph\.?d|j\.?d\b|m\.?d\b|senior fellow|director\b|analyst\b|research\w*\b|economist\b|lecturer\b|chair\b|scientist\b|engineer\b|attorney\b|commissioner\b)"
CREDENTIAL = r"(prof(?:essor)?\b|ph\.?d|j\.?d\b|m\.?d\b|senior fellow|director\b|analyst\b|research(?:er)?\b|economist\b|lecturer\b|chair\b)"
# Words that open a sentence and are no author; words of institutions and honorifics around names.
NOT_AUTHORS = (
    "the", "a", "an", "i", "we", "they", "he", "she", "it", "this", "that", "these", "those", "there", "here", "and", "but", "or", "if", "as", "in",
    "on", "at", "by", "for", "of", "to", "from", "with", "my", "our", "your", "his", "her", "their", "its", "no", "not", "first", "second", "third",
    "next", "thus", "therefore", "however", "moreover", "furthermore", "also", "resolved", "contention", "value", "criterion", "framework", "observation",
    "prefer", "because", "since", "when", "while", "all", "any", "every",
)
INSTITUTION = (
    "university", "univ", "college", "school", "institute", "institution", "department", "dept", "professor", "prof", "phd", "ph", "jd", "md",
    "director", "fellow", "senior", "associate", "assistant", "chair", "research", "researcher", "analyst", "economist", "scientist", "lecturer",
    "of", "at", "the", "for", "and", "in", "on", "law", "review", "press", "et", "al", "inc", "llc", "corp", "center", "centre", "programme",
    "program", "staff", "writer", "correspondent", "editor", "reporter",
)
HONORIFIC = ("dr", "mr", "mrs", "ms", "prof", "sir", "rev", "hon")
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźžż"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz"
_DASHES = " :—–-"


def words_in(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def blank(c: Column) -> Column:
    """True for null and for nothing but white space."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""


def strip_speech_prefix(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(title), "(?i)" + SPEECH_PREFIX, ""), F.lit(_DASHES))


def answers_target(title: Column) -> Column:
    """What an answer block answers, null for any other title."""
    t = F.trim(title)
    target = F.trim(F.regexp_replace(t, "(?i)" + ANSWER_PREFIX, ""), F.lit(_DASHES))
    return F.when(t.rlike("(?i)" + ANSWER_PREFIX) & (target != ""), target)


def normalize_title(title: Column) -> Column:
    """Without speech and answer prefix, lower case, words only; null counts as empty."""
    t = strip_speech_prefix(F.coalesce(title, F.lit("")))
    t = F.coalesce(answers_target(t), t)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))


def content_tokens(normalized: Column) -> Column:
    """Distinct words of a normalised title that are longer than two letters and no stop words."""
    return F.array_distinct(F.filter(F.array_except(F.split(normalized, " "), words_in(TITLE_STOP)), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_similarity(norm_a: Column, norm_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """0 for an empty title, 1 for equal ones, else Jaccard of the content tokens."""
    return F.when((norm_a == "") | (norm_b == ""), F.lit(0.0)).when(norm_a == norm_b, F.lit(1.0)).otherwise(jaccard(tokens_a, tokens_b))


def shingles(words: Column, width: int = 5) -> Column:
    """Distinct ``width``-word shingles; a shorter text is one shingle, an empty one has none.

    ``words`` should be a stored column: the expression reads it once per shingle.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, width), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def infer_side(path: Column, title: Column) -> Column:
    """aff, neg or unknown, by which side's markers occur more often."""
    hay = F.lower(F.concat_ws(" ", path, title))
    aff, neg = F.regexp_count(hay, F.lit(AFF_MARKS)), F.regexp_count(hay, F.lit(NEG_MARKS))
    return F.when(aff > neg, "aff").when(neg > aff, "neg").otherwise("unknown")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


_YEAR = r"(?:^|[^0-9/-])['‘’]?((?:19|20)[0-9]{2}|[0-9]{2})(?:[^0-9]|$)"
_URL = r"https?://[^\s)\]>,]+"


def cite_url(raw: Column) -> Column:
    return F.rtrim(_first(raw, f"({_URL})"), F.lit(".,;"))


def cite_year(raw: Column) -> Column:
    """The first year in the first 80 characters, else anywhere; two digits from 90 on are of the 1900s."""
    y = F.coalesce(_first(F.substring(raw, 1, 80), _YEAR), _first(raw, _YEAR)).cast("int")
    return F.when(y >= 1900, y).when(y >= 90, y + 1900).otherwise(y + 2000)


def cite_title(raw: Column) -> Column:
    return F.trim(_first(raw, r"[\"“]([^\"”]{6,200})[\"”]"))


def cite_author(raw: Column) -> Column:
    """Leading capitalised words that read like a name."""
    lead = r"^\s*(?:\[[^\]]*\]\s*)?(\p{Lu}[\p{L}\p{N}_.'’-]*(?:\s+(?:et\s+al\.?|and|&|de|van|von|der))?(?:[,\s]+\p{Lu}[\p{L}\p{N}_.'’-]*){0,3})"
    name = F.trim(_first(raw, lead), F.lit(" ,"))
    return F.when(plausible_author(name) & ((F.upper(name) != name) | (F.size(F.split(name, r"\s+")) <= 3)), name)


def plausible_author(name: Column) -> Column:
    """No sentence opener in front, and no lone token of one or two letters."""
    toks = F.filter(F.transform(F.split(name, r"\s+"), lambda t: F.lower(F.trim(t, F.lit(".,")))), lambda t: t != "")
    head = F.try_element_at(toks, F.lit(1))
    return F.coalesce((F.size(toks) > 0) & ~F.array_contains(words_in(NOT_AUTHORS), head) & ~((F.size(toks) == 1) & (F.length(head) <= 2)), F.lit(False))


def cite_publication(raw: Column) -> Column:
    """The first parenthesis without URL and title, up to its comma, unless it is a number."""
    inner = F.regexp_replace(F.regexp_replace(_first(raw, r"\(([^)]{3,120})\)"), _URL, ""), r"[\"“][^\"”]{6,200}[\"”]", "")
    inner = F.trim(inner, F.lit(" ,;"))
    return F.when(~F.regexp_replace(inner, "[/-]", "").rlike(r"^[0-9]+$"), F.nullif(F.trim(F.substring_index(inner, ",", 1)), F.lit("")))


def cite_credentials(raw: Column) -> Column:
    """The clause between commas that holds the first credential, at most 60 characters past it."""
    head = F.regexp_extract(raw, f"(?is)^(.*?){CREDENTIAL}", 1)
    hit = F.regexp_extract(raw, f"(?is){CREDENTIAL}", 1)
    start = F.length(F.regexp_extract(head, "(?s)^(.*,)", 1))
    end = F.length(head) + F.length(hit)
    after = F.substr(raw, end + 1, F.length(raw))
    tail = F.when(after.contains(","), F.substring_index(after, ",", 1)).otherwise(F.substring(after, 1, 60))
    return F.when(hit != "", F.trim(F.concat(F.substr(raw, start + 1, end - start), tail), F.lit(" ,[]")))


def parse_cite(raw: Column) -> Column:
    """author, year, title, credentials, publication and url of a source line."""
    raw = F.trim(raw)
    return F.struct(
        cite_author(raw).alias("author"), cite_year(raw).alias("year"), cite_title(raw).alias("title"), cite_credentials(raw).alias("credentials"), cite_publication(raw).alias("publication"), cite_url(raw).alias("url")
    )


def looks_like_cite(text: Column) -> Column:
    """8 to 500 characters, a year early on, and two of: URL, quoted title, parentheses, credential, short."""
    n = F.length(text)
    marks = [text.rlike(_URL), text.rlike(r"[\"“][^\"”]{6,200}[\"”]"), text.rlike(r"\([^)]*\)"), text.rlike("(?i)" + CREDENTIAL), n < 200]
    score = reduce(lambda a, b: a + b, [m.cast("int") for m in marks])
    return F.coalesce((n >= 8) & (n <= 500) & F.substring(text, 1, 80).rlike(_YEAR) & (score >= 2), F.lit(False))


def strip_accents(c: Column) -> Column:
    """Lower case with accented Latin letters replaced."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def author_key(name: Column) -> Column:
    """The last telling word of a name: a surname; empty where there is none."""
    s = F.substring_index(strip_accents(F.coalesce(name, F.lit(""))), ",", 1)
    toks = F.split(F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s'-]", " "), r"\s+", " ")), " ")
    kept = F.filter(F.array_except(toks, words_in(HONORIFIC + INSTITUTION)), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))


def similar_keys(a: Column, b: Column) -> Column:
    """Equal, or one edit apart late in two long words without digits."""
    n = F.least(F.length(a), F.length(b))
    common = F.greatest(F.lit(4), n - 2)
    near = (n >= 5) & ~a.rlike("[0-9]") & ~b.rlike("[0-9]") & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.substr(a, F.lit(1), common) == F.substr(b, F.lit(1), common)) & (F.levenshtein(a, b) <= 1)
    return (a == b) | near


def group_author_keys(keys: Column) -> Column:
    """Representatives of an array of keys: in order of length and text, each key joins the first similar one before it."""
    clean = F.filter(F.array_distinct(keys), lambda k: k.isNotNull() & (k != ""))
    ordered = F.transform(F.array_sort(F.transform(clean, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))), lambda x: x["k"])
    return F.aggregate(ordered, F.array().cast("array<string>"), lambda acc, k: F.when(F.exists(acc, lambda r: similar_keys(k, r)), acc).otherwise(F.concat(acc, F.array(k))))


def short_cite(author: Column, year: Column, raw: Column) -> Column:
    """Author and two-digit year, the author, or 40 characters of the line."""
    two = F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0")
    return F.when(author.isNotNull() & year.isNotNull(), F.concat(author, F.lit(" '"), two)).otherwise(F.coalesce(author, F.substring(raw, 1, 40)))


def warrant_flags(tag: Column, body: Column, read: Column, ratio: Column, year: Column) -> Column:
    """Prompts to read a card again: no_read, thin_read or over_read, undated, hedged_body.  A null or NaN ratio counts as 0."""
    r = F.when(F.isnan(ratio), F.lit(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))
    t, b = F.coalesce(tag, F.lit("")), F.coalesce(body, F.lit(""))
    hedged = b.rlike("(?i)" + FLAG_HEDGE) & t.rlike("(?i)" + FLAG_STRONG) & ~t.rlike("(?i)" + FLAG_HEDGE)
    return F.array_compact(
        F.array(
            F.when(blank(read), F.lit("no_read")).when(r < 0.12, F.lit("thin_read")).when(r > 0.92, F.lit("over_read")),
            F.when(year.isNull(), F.lit("undated")),
            F.when(hedged, F.lit("hedged_body")),
        )
    )


def owner_of(source_path: Column, source_id: Column) -> Column:
    """The folder of a file, either slash, else the source's id."""
    parts = F.filter(F.split(F.regexp_replace(source_path, r"\\", "/"), "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), source_id)


def evidence_status(cite: Column, source_id: Column, read: Column, disclosed: Column) -> Column:
    """traceable, attributed or needs-review: whether a reader can get back to the source."""
    cited = ~blank(cite) & ~blank(source_id)
    return F.when(cited & (~blank(read) | F.coalesce(disclosed, F.lit(False))), "traceable").when(cited, "attributed").otherwise("needs-review")


def age_days(fetched_at: Column, now: Column) -> Column:
    """Whole days since an ISO time, never below 0; null where it is no time."""
    t = F.try_to_timestamp(F.nullif(F.trim(fetched_at), F.lit("")))
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(t)) / 86400)
    return F.when(days < 0, F.lit(0)).otherwise(days)


def source_freshness(fetched_at: Column, failed_at: Column, slow: Column, now: Column) -> Column:
    """refresh-failed, unknown, stale or fresh: stale from 30 days, from 90 for origins that change slowly."""
    age = age_days(fetched_at, now)
    return F.when(~blank(failed_at), "refresh-failed").when(age.isNull(), "unknown").when(age >= F.when(slow, 90).otherwise(30), "stale").otherwise("fresh")


def matched_terms(query: str, *texts: Column) -> Column:
    """The query's words of three letters or more that occur as whole words, in query order."""
    import re

    terms = list(dict.fromkeys(t for t in re.findall(r"[\w'-]+", query.lower()) if len(t) >= 3))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    found = [F.when(hay.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(t)}(?![\p{{L}}\p{{N}}_])"), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def match_quality(terms: Column, lexical_rank: Column, vector_rank: Column) -> Column:
    """Struct of confidence and match type: a signal of ranking, not of truth."""
    exact = (F.size(terms) > 0) & lexical_rank.isNotNull()
    kind = F.when(exact, "exact").when(lexical_rank.isNotNull() & vector_rank.isNotNull(), "hybrid").when(lexical_rank.isNotNull(), "lexical").otherwise("semantic")
    sure = F.when(exact & (lexical_rank <= 5), "high").when(lexical_rank.isNotNull(), "medium").otherwise("exploratory")
    return F.struct(sure.alias("confidence"), kind.alias("match_type"))


def match_reasons(terms: Column, lexical_rank: Column, vector_rank: Column) -> Column:
    out = F.array_compact(
        F.array(
            F.when(F.size(terms) > 0, F.concat(F.lit("exact: "), F.array_join(F.slice(terms, 1, 6), ", "))),
            F.when(lexical_rank.isNotNull(), F.concat(F.lit("lexical rank #"), lexical_rank.cast("string"))),
            F.when(vector_rank.isNotNull(), F.concat(F.lit("semantic rank #"), vector_rank.cast("string"))),
        )
    )
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("semantic similarity")))


def vector_text(tag: Column, read: Column, body: Column) -> Column:
    """Tag and read text, or the body where the read text is short."""
    return F.concat_ws(" ", tag, F.when(F.length(F.coalesce(read, F.lit(""))) > 40, read).otherwise(body))


def grounding_text(c: Column) -> Column:
    """For comparing quotations: accents, quotes, dashes, case, punctuation and spacing don't matter."""
    s = strip_accents(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))


def quote_holds(quote: Column, *texts: Column) -> Column:
    """Whether a quotation stands in the texts: short ones pass, else as written, else 85 % of four words or more."""
    q = grounding_text(quote)
    hay = grounding_text(F.concat_ws(" ", *texts))
    words, have = F.split(q, " "), F.split(hay, " ")
    share = F.size(F.filter(words, lambda w: F.array_contains(have, w))) / F.size(words)
    return (F.length(q) < 12) | hay.contains(q) | ((F.size(words) >= 4) & (share >= 0.85))


def label_index(label: Column) -> Column:
    """The number in a label such as C3, [C3] or 3; null otherwise."""
    return F.nullif(F.regexp_extract(F.trim(label), r"^\[?\s*[Cc]?\s*([0-9]+)\s*\]?$", 1), F.lit("")).cast("int")


def json_payload(c: Column) -> Column:
    """The JSON in a model's answer: the whole, a fenced block, the widest braces, or that without trailing commas; null if none parses."""
    fenced = _first(c, r"(?s)```(?:json)?\s*(.*?)```")
    wide = _first(c, r"(?s)(\{.*\}|\[.*\])")
    repaired = F.regexp_replace(wide, r",\s*([}\]])", "$1")

    def valid(x: Column) -> Column:
        return F.when(x.isNotNull() & F.try_parse_json(x).isNotNull(), F.trim(x))

    return F.coalesce(*[valid(x) for x in (c, fenced, wide, repaired)])


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def safe_member(name: Column) -> Column:
    """An archive member that stays inside its folder."""
    bad = name.rlike(r"^(?:/|\\|[A-Za-z]:)") | name.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)") | name.contains("\u0000") | (F.trim(name) == "")
    return F.coalesce(~bad, F.lit(False))
