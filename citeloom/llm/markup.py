"""Clean text and structure from HTML, Markdown, wiki and LaTeX.

A record is cut into code blocks, formulas, headings, list items and running text by one
pass of each grammar.  The best contiguous content region is found by a linear scan in
which words add to the score and marks of all grammars take from it (weights from labelled
pages, whose clean text is aligned with them word by word; words in elements that hold
boilerplate there take too), and elements and marks outside the region are dropped.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty

_SIGNS = re.compile(r"[<\\`*_~^$={}&#|+]|\[\[|\]\(|''|^(?:[-+*] |\d{1,3}[.)] |-{3,}|    |\t)", re.M)
_CODE = re.compile(
    r"<pre\b[^>]*>.*?</pre\s*>|<(syntaxhighlight|source)\b[^>]*>.*?</\1\s*>"
    r"|\\begin\{(verbatim|lstlisting|minted)\*?\}.*?\\end\{\2\*?\}"
    r"|^(```+|~~~+)[^\n`]*\n.*?^\3[ \t]*$"
    r"|(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*\S[^\n]*(?:\n|\Z)(?:[ \t]*\n(?=(?: {4}|\t)))*)+",
    re.S | re.M | re.I,
)
_FORMULA = re.compile(
    r"<span\b[^>]*\bclass\s*=\s*[\"']?math\b[^>]*>.*?</span\s*>|<math\b[^>]*>.*?</math\s*>"
    r"|\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)\*?\}.*?\\end\{\1\*?\}"
    r"|\$\$.+?\$\$|(?<!\\)\\\[.*?\\\]|(?<!\\)\\\(.*?\\\)"
    r"|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?[\\^_=][^$\n]*?(?<=[^\s$])\$(?![\d$])",
    re.S | re.I,
)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:[\s/][^<>]*)?>")
_HTML_ITEM = re.compile(r"<(h[1-6]|li)\b[^>]*>(.*?)(?=</\1\s*>|<li\b|</[uo]l\s*>|<h[1-6]\b|\Z)", re.S | re.I)
_LATEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{([^{}\n]*)\}")
_LATEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*(.*?)(?=\\item\b|\\end\{|\n[ \t]*\n|\Z)", re.S)
_LINE = re.compile(
    r"^[ \t]{0,3}(?:(?P<atx>#{1,6})[ \t]+(?P<atxt>\S[^\n]*)|(?P<wiki>={1,6})[ \t]*(?P<wtxt>[^=\n][^\n]*?)[ \t]*(?P=wiki)[ \t]*$"
    r"|(?P<bul>[-+]|\*{1,4}|\d{1,3}[.)])[ \t]+(?P<btxt>\S[^\n]*))|^(?P<stxt>[^\s\n#<\\=][^\n]*)\n[ \t]{0,3}(?:-{3,}|={3,})[ \t]*$",
    re.M,
)
#: Tags that shape the text and are no marks within it.
_BLOCK_TAGS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li pre html body head section article main header footer table tbody thead tr td th dl dt dd blockquote hr".split())
_INLINE = re.compile(
    r"<!--|&(?:#\d+|#x[0-9a-f]+|[a-z][a-z0-9]*);|\[\[|\]\]|\{\{|\}\}|\]\([^)\s]*\)|!\[|\[\^[^\]\s]+\]|''|~~|``|`[^`\n]+`"
    r"|(?<![\w*])\*(?=[\w\[(\"'~])[^*\n]*[^\s*]\*(?![\w*])|(?<!\*)\*{2,3}(?=[\w\[(\"'])|(?<=[\w.,;:!?)\]])\*{2,3}(?!\*)"
    r"|(?<!\w)_(?=[A-Za-z0-9\[])[^_\n]*[^\s_]_(?!\w)|(?<!\w)_{2,3}(?=[A-Za-z0-9\[])|(?<=[\w.,;:!?)\]])_{2,3}(?!\w)"
    r"|\{\\[a-z]+\b|\\(?:emph|text[a-z]{2}|underline|href|url|footnote|cite[a-z]*|ref|label|enquote|uline|sout|textcolor|includegraphics|quote)\b|\\(?:em|bf|it|tt|sc|sl)\b|\\\\|~\\"
    r"|\\begin\{(?:quote|quotation|center)\}|\\(?:newline|linebreak|par)\b",
    re.I,
)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_LATEX_ENV = re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?")
#: Words, and the marks of the four grammars: tags, commands, brackets, quotes, signs.
_TOKEN = re.compile(r"(?P<word>\w+)|</?(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:[\s/][^<>]*)?>|(?P<mark>\\[A-Za-z]+|\{\{|\}\}|\[\[|\]\]|\]\(|''+|={2,}|[*_~`#|]+)")
#: Elements that may hold boilerplate; others stand within running text.
_HOLDERS = (_BLOCK_TAGS - set("h1 h2 h3 h4 h5 h6 pre".split())) | frozenset("nav aside form button script style noscript iframe select option figure menu dialog address fieldset template".split())
#: Marks of headings, which stand at the edge of what they head: they cost the least.
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 # == \\part \\chapter \\section \\subsection \\subsubsection \\paragraph \\subparagraph".split())
_VOID = frozenset("br hr img input link meta col area base source wbr".split())
#: A wiki's own marks: they tell its numbered items from headings that begin with one sign.
_WIKI = re.compile(r"^={2,6}[^=\n]+={2,6}[ \t]*$|\[\[|\{\{|'''|<ref\b|<math\b", re.M | re.I)

#: Scores of the scan where none are fitted: a word, and a mark of any kind; prior weight of fitted ones.
WORD_SCORE, TAG_SCORE, PRIOR = 1.0, -0.25, 20.0
#: What a mark costs at least, and in addition where all its occurrences lie outside the content.
LEAST_COST, MOST_COST = 0.02, 0.5


def parse(text: str, weights: dict[str, float] | None = None) -> tuple[list[tuple[str, int, int, str]], bool, tuple[int, int]]:
    """Elements (kind, start, end, content) of the content region in reading order, whether its running text carries marks, and the region."""
    if not text or not _SIGNS.search(text):
        return [], False, (0, len(text or ""))
    lo, hi = region(text, weights)
    whole = lo == 0 and hi == len(text)
    found: list[tuple[str, int, int, str]] = []

    def cut(kind):
        def blank(m):
            if kind == "code" and not m[0].strip():
                return m[0]
            found.append((kind, m.start(), m.end(), m[0]))
            return re.sub(r"[^\n]", " ", m[0]) if kind == "code" else " " * len(m[0])

        return blank

    comments = False
    if "<!--" in text:
        comments = any(m.start() < hi and m.end() > lo for m in _COMMENT.finditer(text))
        text = _COMMENT.sub(lambda m: " " * len(m[0]), text)
    text = _CODE.sub(cut("code"), text)
    text = _FORMULA.sub(cut("formula"), text)
    if "<" in text:
        for m in _HTML_ITEM.finditer(text):
            found.append(("heading" if m[1][0] in "hH" else "list_item", m.start(), m.end(), m[2]))
    if "\\" in text:
        found += [("heading", m.start(), m.end(), m[1]) for m in _LATEX_HEAD.finditer(text)]
        found += [("list_item", m.start(), m.end(), m[1]) for m in _LATEX_ITEM.finditer(text)]
    for m in _LINE.finditer(text):
        if m["atx"]:
            found.append(("list_item" if len(m["atx"]) == 1 and _numbered(text, m) else "heading", m.start(), m.end(), m["atxt"]))
        elif m["wiki"]:
            found.append(("heading", m.start(), m.end(), m["wtxt"]))
        elif m["bul"]:
            found.append(("list_item", m.start(), m.end(), m["btxt"]))
        elif not m["stxt"].rstrip().endswith((".", "!", "?")):
            found.append(("heading", m.start(), m.end(), m["stxt"]))
    found.sort(key=lambda x: x[1])
    if not whole:
        found = [f for f in found if f[1] < hi and f[2] > lo]
        text = text[lo:hi]
    inline = comments or bool(_INLINE.search(_LINE.sub(lambda m: " " + (m["atxt"] or m["wtxt"] or m["btxt"] or m["stxt"]), text)))
    if not inline and "<" in text:
        inline = any(m[1].lower() not in _BLOCK_TAGS for m in _TAG.finditer(text))
    return found, inline, (lo, hi)


def _numbered(text: str, m: re.Match) -> bool:
    """Whether a line after a single "#" is a numbered item of a wiki: it has such lines beside it, a full stop, or the record a wiki's marks."""
    if m["atxt"].rstrip()[-1:] in ".!?" or text.startswith("# ", m.end() + 1):
        return True
    before = text.rfind("\n", 0, max(0, m.start() - 1)) + 1
    return m.start() > 0 and text.startswith("# ", before) or bool(_WIKI.search(text))


def scored(text: str):
    """(start, end, name or None for a word, holders) of each token; ``holders`` are the elements that a word stands in."""
    stack: list[str] = []
    held: frozenset[str] = frozenset()
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            yield m.start(), m.end(), None, held
        elif kind == "tag":
            name = m["tag"].lower()
            if text[m.start() + 1] == "/":
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif name not in _VOID and text[m.end() - 2] != "/":
                stack.append(name)
            held = _HOLDERS.intersection(stack)
            yield m.start(), m.end(), name, held
        else:
            mark = m["mark"]
            yield m.start(), m.end(), mark if mark[0] == "\\" else mark[:2] if mark[0] in "{}[]='" else mark[0], held


def region(text: str, weights: dict[str, float] | None = None) -> tuple[int, int]:
    """Start and end of the maximum-scoring run of tokens (the first of equal ones).

    A word scores by the least favourable element that it stands in (weights "<name>"), a
    mark by its name.  Text without words is one region.
    """
    weights = weights or {}
    word, other = weights.get("", WORD_SCORE), weights.get("*", TAG_SCORE)
    best = total = 0.0
    start = lo = hi = 0
    known: dict[frozenset, float] = {frozenset(): word}
    for a, b, name, held in scored(text):
        if total <= 0:
            total, start = 0.0, a
        if name is None:
            value = known.get(held)
            if value is None:
                value = known[held] = min(weights.get(f"<{h}>", word) for h in held)
            total += value
        else:
            total += weights.get(name, other)
        if total > best:
            best, lo, hi = total, start, b
    if not hi:
        return 0, len(text)
    hi += len(re.match(r"[.,;:!?\"')\u201d]*", text[hi:])[0])
    # marks before the first word and after the last one belong to these
    return 0 if not _has_word(text[:lo]) else lo, len(text) if not _has_word(text[hi:]) else hi


def _has_word(text: str) -> bool:
    return any(m.lastgroup == "word" for m in _TOKEN.finditer(text))


def structure(text: str | None, weights: dict[str, float] | None = None) -> list[tuple[str, int]]:
    """(element, seq) rows of a record's content region: seq counts from 1 per element; ``inline`` has seq 0."""
    found, inline, _ = parse(text or "", weights)
    seen: Counter = Counter()
    out = []
    for kind, *_ in found:
        seen[kind] += 1
        out.append((kind, seen[kind]))
    return [*out, ("inline", 0)] if inline else out


_STRIP = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]\n]*)\]\([^)\s]*\)"), r"\1"),
    (re.compile(r"\[\^[^\]\s]+\]"), ""),
    (re.compile(r"<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/>", re.S | re.I), ""),
    (re.compile(r"\{\{(?:cn|fact|citation needed)\b[^{}]*\}\}", re.I), ""),
    (re.compile(r"\{\{[^{}|]*\|([^{}]*)\}\}"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]"), r"\1"),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"~?\\(?:footnote|cite[a-z]*|label|ref)\{[^{}]*\}"), ""),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\[a-z]+\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\{\\[a-z]+\s+([^{}]*)\}"), r"\1"),
    (re.compile(r"\\\\"), "\n"),
    (re.compile(r"~{3,5}"), ""),
    (re.compile(r"~~([^~]*)~~"), r"\1"),
    (re.compile(r"(?<![\w*])\*{1,3}(?=\S)|(?<=\S)\*{1,3}(?![\w*])"), ""),
    (re.compile(r"(?<![\w_])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![\w_])"), ""),
    (re.compile(r"``|(?<!`)`(?!`)"), ""),
]
_BREAK = re.compile(r"</?(?:p|div|ul|ol|h[1-6]|li|br|tr|table|blockquote)\b[^>]*>", re.I)


def _bare(text: str) -> str:
    text = _COMMENT.sub("", text)
    text = _LATEX_ENV.sub("\n", text)
    for pattern, to in _STRIP:
        text = pattern.sub(to, text)
    text = _TAG.sub("", _BREAK.sub("\n", text))
    return html.unescape(text) if "&" in text else text


def clean(text: str | None, weights: dict[str, float] | None = None) -> str | None:
    """Plain text that keeps headings (``# ``), list items (``- ``), fenced code and ``$$`` formulas."""
    if not text:
        return text
    found, inline, (lo, hi) = parse(text, weights)
    if not found and not inline and not _TAG.search(text):
        return text
    out, at = [], 0
    for kind, start, end, content in found:
        if start < at:
            continue
        out.append(_bare(text[max(at, lo) : start]) if start > lo else "")
        if start < hi and end > lo:
            if kind == "code":
                body = re.sub(r"^(?:```+|~~~+)[^\n]*\n|\n?(?:```+|~~~+)\s*$", "", re.sub(r"</?(?:pre|code|syntaxhighlight|source)\b[^>]*>|\\(?:begin|end)\{\w+\*?\}", "", content))
                out.append("\n\n```\n" + body.strip("\n") + "\n```\n\n")
            elif kind == "formula":
                body = re.sub(r"</?(?:span|math)\b[^>]*>|\\(?:begin|end)\{\w+\*?\}", "", content).strip()
                out.append("\n\n$$" + re.sub(r"^(?:\$\$?|\\[\[(])|(?:\$\$?|\\[\])])$", "", body).strip() + "$$\n\n")
            else:
                out.append(("\n\n# " if kind == "heading" else "\n- ") + " ".join(_bare(content).split()) + "\n" * (kind == "heading") + "\n" * (kind == "heading"))
        at = end
    out.append(_bare(text[max(at, lo) : max(hi, at)]))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(out))).strip() if not any(f[0] == "code" for f in found) else re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def aligned(page: list[str], clean_words: list[str]) -> list[bool]:
    """Which words of a page are words of its clean text, both taken in order.

    Each word of the clean text goes to its next place on the page; a far place counts only
    if the following word stands next to it.
    """
    places: dict[str, list[int]] = {}
    for i, w in enumerate(page):
        places.setdefault(w, []).append(i)
    inside, at = [False] * len(page), -1
    for k, w in enumerate(clean_words):
        own = places.get(w, ())
        i = bisect_right(own, at)
        while i < len(own):
            j = own[i]
            if j - at <= NEAR or (k + 1 < len(clean_words) and j + 1 < len(page) and page[j + 1] == clean_words[k + 1]):
                inside[j], at = True, j
                break
            i += 1
    return inside


#: Words that alignment passes over without a second word that agrees.
NEAR = 3


def fit_weights(labelled: DataFrame, markup: str, text: str, most: int = 2_000) -> dict[str, float]:
    """Scores of words and marks, from pages whose clean text is known.

    Page and clean text are aligned word by word.  A word scores the share of words inside
    the content, less a half: "" for all, "<name>" for those in an element.  A mark costs
    ``LEAST_COST``, and more the more often the words on its two sides are outside.  Shares
    are smoothed by ``PRIOR`` occurrences.  At most ``most`` pages are used (the first by
    hash of their text, so any page may be among them).
    """
    rows = labelled.select(F.col(markup).alias("m"), F.col(text).alias("t")).where("m is not null and t is not null").withColumn("h", F.xxhash64("m", "t"))
    last = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    inside: Counter = Counter()
    total: Counter = Counter()
    for r in rows.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).select("m", "t").toLocalIterator() if last is not None else ():
        # headings, code and formulas are content whether or not the clean text has them, so they tell nothing
        found = sorted((x[1], x[2]) for x in parse(r.m, {"*": 0.0})[0] if x[0] != "list_item")
        tokens, k = [], 0
        for a, b, name, held in scored(r.m):
            while k < len(found) and found[k][1] <= a:
                k += 1
            tokens.append((r.m[a:b], name, held, k < len(found) and found[k][0] < b))
        flags = iter(aligned([w for w, name, _, element in tokens if name is None and not element], re.findall(r"\w+", r.t)))
        marks: list[str] = []
        before = None
        for _, name, held, element in tokens:
            if name is not None:
                if before is not None:
                    total[name] += 1
                    inside[name] += before
                marks.append(name)
                continue
            before = None if element else float(next(flags))
            if before is not None:
                for n in ("", *(f"<{h}>" for h in held)):
                    total[n] += 1
                    inside[n] += before
                for n in (*marks, *["*"] * len(marks)):
                    total[n] += 1
                    inside[n] += before
            marks = []

    def share(n, prior):
        return (inside[n] + PRIOR * prior) / (total[n] + PRIOR)

    usual, marked = share("", 1.0), share("*", 0.5)
    out = {n: share(n, usual) - 0.5 if n[:1] == "<" else -LEAST_COST - MOST_COST * (1.0 - share(n, marked)) for n in total if n not in ("", "*")}
    out |= dict.fromkeys(_HEADS, -LEAST_COST)
    out[""] = max(0.1, usual - 0.5)
    out["*"] = -LEAST_COST - MOST_COST * (1.0 - marked) if total["*"] else TAG_SCORE
    return out


def find_elements(records: DataFrame, key: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(rec_key, element, seq) for each structural element of each record.

    Null and empty texts have no elements.  Repeated records give repeated rows.
    """

    @nonempty
    def elements(batches):
        for pdf in batches:
            keys, kinds, seqs = [], [], []
            for k, t in zip(pdf["rec_key"], pdf["text"]):
                for kind, seq in structure(t, weights):
                    keys.append(k)
                    kinds.append(kind)
                    seqs.append(seq)
            yield pd.DataFrame({"rec_key": pd.Series(keys, dtype=object), "element": pd.Series(kinds, dtype=object), "seq": pd.Series(seqs, dtype="int32")})

    rows = records.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return rows.mapInPandas(elements, "rec_key string, element string, seq int")


def clean_text(records: DataFrame, text: str, out: str = "clean", weights: dict[str, float] | None = None) -> DataFrame:
    """``records`` with the clean text in column ``out``; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: clean(t, weights), na_action="ignore")

    return records.withColumn(out, run(F.col(text)))
