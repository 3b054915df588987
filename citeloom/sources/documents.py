"""Styled documents and archived wiki pages as paragraph rows.

Only the leaf that turns bytes into rows is Python; sectioning is done by windows
(``citeloom.operators.graph.sections``).
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "source_id string, ordinal int, level int, style string, text string, read_text string, emphasis_text string, runs int, marked int"
#: Sign between parts of a text that don't adjoin.
ELISION = " … "
# What style names say about marks and levels.
STYLE_LEVELS = {"heading 1": 1, "pocket": 1, "heading 2": 2, "hat": 2, "heading 3": 3, "block": 3, "heading 4": 4, "tag": 4}
READ_STYLES, BOLD_STYLES = ("underline", "emphasis", "highlight"), ("emphasis", "bold", "strong")
MOST_HOPS = 6


def _on(props, name: str):
    """True, False or None: a mark in run properties."""
    el = None if props is None else props.find(_W + name)
    if el is None:
        return None
    return el.get(_W + "val", "true").lower() not in ("0", "false", "none", "off")


class Styles:
    """Marks and levels that styles give, each looked up along at most ``MOST_HOPS`` parents and remembered."""

    def __init__(self, xml: bytes | None):
        self.styles = {}
        self.known: dict = {}
        if xml:
            for s in ElementTree.fromstring(xml).iter(_W + "style"):
                name = s.find(_W + "name")
                based = s.find(_W + "basedOn")
                self.styles[s.get(_W + "styleId")] = (name.get(_W + "val", "").lower() if name is not None else "", based.get(_W + "val") if based is not None else None, s.find(_W + "rPr"), s.find(_W + "pPr"))

    def chain(self, style: str | None):
        for _ in range(MOST_HOPS):
            if style not in self.styles:
                return
            yield self.styles[style]
            style = self.styles[style][1]

    def mark(self, style: str | None, name: str, by_name: bool):
        key = (style, name, by_name)
        if key not in self.known:
            self.known[key] = self._mark(style, name, by_name)
        return self.known[key]

    def _mark(self, style, name, by_name):
        hints = {"u": READ_STYLES, "b": BOLD_STYLES}.get(name, ())
        for title, _, run, _ in self.chain(style):
            on = _on(run, name)
            if on is not None:
                return on
            if by_name and any(h in title for h in hints):
                return True
        return None

    def level(self, style: str | None, props) -> int | None:
        el = None if props is None else props.find(_W + "outlineLvl")
        if el is None:
            for title, _, _, para in self.chain(style):
                if title in STYLE_LEVELS:
                    return STYLE_LEVELS[title]
                el = None if para is None else para.find(_W + "outlineLvl")
                if el is not None:
                    break
        n = int(el.get(_W + "val", "9")) + 1 if el is not None else 9
        return n if n <= 4 else None


def stitch(parts: list[tuple[str, bool]]) -> str:
    """The marked parts in order, with an elision where unmarked text that isn't blank was left out."""
    out, skipped = "", False
    for text, marked in parts:
        if marked:
            out += (ELISION if skipped and out else "") + text
            skipped = False
        elif text.strip():
            skipped = True
    return out.strip()


def docx_paragraphs(content: bytes) -> list[tuple]:
    """(ordinal, level, style, text, read_text, emphasis_text, runs, marked) of a document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        styles = Styles(z.read("word/styles.xml") if "word/styles.xml" in names else None)
        body = ElementTree.fromstring(z.read("word/document.xml"))
    rows = []
    for ordinal, p in enumerate(body.iter(_W + "p")):
        props = p.find(_W + "pPr")
        el = None if props is None else props.find(_W + "pStyle")
        style = el.get(_W + "val") if el is not None else None
        read, strong, text, runs, marked = [], [], "", 0, 0
        for r in p.iter(_W + "r"):
            t = "".join((x.text or "") if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" if x.tag == _W + "br" else "" for x in r)
            if not t:
                continue
            own = r.find(_W + "rPr")
            el = None if own is None else own.find(_W + "rStyle")
            char = el.get(_W + "val") if el is not None else None

            def mark(name, own=own, char=char, style=style):
                for v in (_on(own, name), styles.mark(char, name, True), styles.mark(style, name, False)):
                    if v is not None:
                        return v
                return False

            under, light = mark("u"), mark("highlight")
            is_read = (under or light) and not mark("strike")
            read.append((t, is_read))
            strong.append((t, is_read and (mark("b") or (under and light))))
            text += t
            runs += 1
            marked += is_read
        if text.strip():
            rows.append((ordinal, styles.level(style, props), style, text.strip(), stitch(read), stitch(strong), runs, marked))
    return rows


def _leaf(parse):
    def run(batches):
        for pdf in batches:
            rows = []
            for source, content in zip(pdf["source_id"], pdf["content"]):
                try:
                    rows += [(source, *r) for r in parse(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, UnicodeDecodeError, TypeError):
                    rows.append((source, -1, None, "!failed", "", "", "", 0, 0))
            if rows:
                yield pd.DataFrame(rows, columns=["source_id", "ordinal", "level", "style", "text", "read_text", "emphasis_text", "runs", "marked"]).astype(object)

    return run


def read_docx(files: DataFrame) -> DataFrame:
    """Paragraph rows of styled documents (source_id, content); an unreadable file is one row of style ``!failed``."""
    return files.select("source_id", "content").mapInPandas(_leaf(docx_paragraphs), PARAGRAPHS)


class _Wiki(HTMLParser):
    """Headings and paragraphs of an archived page: h4.title opens an entry, other headings a card."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.text, self.level, self.inside = [], [], None, False

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "h3", "h4", "h5"):
            self.flush()
            kind = dict(attrs).get("class") or ""
            self.level = None if tag == "p" else 3 if "title" in kind.split() else 4
            self.inside = True
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "h4", "h5"):
            self.flush()

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)

    def flush(self):
        t = re.sub(r"[ \t\r\f]+", " ", "".join(self.text)).strip()
        if t:
            self.rows.append((self.level, t))
        self.text, self.level, self.inside = [], None, False


def wiki_paragraphs(content: bytes) -> list[tuple]:
    parser = _Wiki()
    parser.feed(content.decode("utf-8", errors="replace"))
    parser.flush()
    return [(i, level, None, t, t if level is None else "", "", 1, int(level is None)) for i, (level, t) in enumerate(parser.rows)]


def read_wiki(files: DataFrame) -> DataFrame:
    """Paragraph rows of archived wiki pages; all that such a page discloses counts as read."""
    return files.select("source_id", "content").mapInPandas(_leaf(wiki_paragraphs), PARAGRAPHS)


def is_wiki_page(content):
    """Whether a page looks like an archived wiki page, by its first 60,000 bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 60_000), "ISO-8859-1"))
    return head.contains("wikigeneratedheader") | (head.contains('class="title"') & head.contains("wiki"))


def split_disclosed(lines):
    """(cite, disclosed) of an array of lines: the first is the cite; lines of nothing but AND or dots become an elision."""
    rest = F.filter(F.slice(lines, 2, 1_000_000), lambda x: F.trim(x) != "")
    text = F.array_join(F.transform(rest, lambda x: F.when(F.trim(x).rlike(r"^(?:AND|\.{2,}|…|\[?…\]?|~+)$"), F.lit("…")).otherwise(F.trim(x))), " ")
    return F.struct(F.try_element_at(lines, F.lit(1)).alias("cite"), text.alias("disclosed"))
