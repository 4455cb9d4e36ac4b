"""Documents of several formats as addressed segments (document_id, locator, text, section).

Parsers take bytes or text and give segments or raise ValueError; segments() runs them over a DataFrame and keeps
one bad document from failing the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from attesta.functions.tex import braced
from attesta.sources.markup import article_segments, word_segments, workbook_segments

MOST_BYTES = 32 << 20
Segment = tuple[str, str, str]
SEGMENT = "document_id string, locator string, text string, section string, status string, error string"


#: Text of a page that asks for something instead of giving an article, and headings of one that gives it (fixed values).
CHALLENGE = re.compile(r"access denied|captcha|sign in to access|just a moment", re.I)
FULL_TEXT = re.compile(r"\b(?:methods?|materials|experiments?|implementation|evaluation|results?)\b")
LEAST_HTML = 500


def _clean(s: str) -> str:
    return " ".join(s.replace("\u00ad", "").split())


class _Node:
    """An element of a page: its name, id and children, which are elements and text."""

    __slots__ = ("tag", "id", "children")

    def __init__(self, tag: str, id_: str = ""):
        self.tag, self.id, self.children = tag, id_, []


class _Tree(HTMLParser):
    """A page as a tree. Elements whose end tag may be left out end where HTML ends them; what is open at the end of the
    page ends there; end tags without a start are passed over."""

    #: Elements without content, and those that begin a block (fixed values of HTML).
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
    #: What a start tag ends: the nearest open element of these, unless one of the others stands between.
    ENDS = {
        "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "tr"}, {"table"}),
    }

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.path = [self.root]

    def _end(self, tags: set[str] | frozenset[str], within: set[str] | frozenset[str] = frozenset()) -> None:
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].tag in tags:
                del self.path[depth:]
                return
            if self.path[depth].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BLOCK:
            self._end({"p"}, {"table", "button"})
        if tag in self.ENDS:
            self._end(*self.ENDS[tag])
        node = _Node(tag, dict(attrs).get("id") or "")
        self.path[-1].children.append(node)
        if tag not in self.VOID:
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.path[-1].children.append(_Node(tag, dict(attrs).get("id") or ""))

    def handle_endtag(self, tag: str) -> None:
        self._end({tag})

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)


#: Elements that become segments, and those whose content is no text (fixed values).
SEGMENTS = frozenset("p h1 h2 h3 h4 table pre".split())
SILENT = frozenset("script style noscript template".split())


def _words(node: _Node) -> str:
    """The text inside an element; cells of a table are set off by bars, rows by semicolons."""
    before = {"td": " | ", "th": " | ", "tr": " ; "}
    parts, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
        elif at.tag not in SILENT:
            parts.append(before.get(at.tag, ""))
            todo.extend(reversed(at.children))
    return _clean("".join(parts))


#: A reference to a character without its semicolon.
UNCLOSED = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def html_segments(page: str, closed: bool = False) -> list[Segment]:
    """Headings, paragraphs, tables and preformatted blocks in order, each under the heading before it. A block inside
    another one is part of it. closed: only references with a semicolon stand for a character (HTML takes `&amp` too)."""
    tree = _Tree()
    tree.feed(UNCLOSED.sub("&amp;", page) if closed else page)
    tree.close()
    out, section, todo = [], "", [tree.root]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.tag in SILENT:
            continue
        if node.tag not in SEGMENTS:
            todo.extend(reversed(node.children))
        elif text := _words(node):
            section = text if node.tag[0] == "h" else section
            out.append((f"html:id={node.id}" if node.id else f"html:block={len(out) + 1}", text, section))
    return out


def parse_html(data: bytes, article: bool = False, closed: bool = False) -> list[Segment]:
    """The page's segments; where an article is wanted, a page of little text, one that asks for a login and one
    without a section on methods or results are refused."""
    page = data.decode("utf-8", "replace")
    out = html_segments(page, closed)
    if article:
        if sum(len(t) for _, t, _ in out) < LEAST_HTML:
            raise ValueError("too little text")
        if CHALLENGE.search(page[:15_000]):
            raise ValueError("an access challenge")
        if not any(FULL_TEXT.search(t.casefold()) for _, t, s in out if t == s):
            raise ValueError("no section on methods or results")
    return out


_TEX_WHOLE = re.compile(r"\\begin\{(?P<env>table\*?|abstract)\}.*?\\end\{(?P=env)\}", re.S)


def parse_tex(data: bytes) -> list[Segment]:
    """Table and abstract environments whole, paragraphs between them, in order, under the section before them."""
    text = re.sub(r"(?<!\\)%.*", "", data.decode("utf-8", "replace"))
    out: list[Segment] = []
    section, at, tables, blocks = "", 0, 0, 0

    def paragraphs(part: str) -> None:
        nonlocal section, blocks
        for block in filter(None, map(str.strip, re.split(r"\n\s*\n", part))):
            if titles := [t for level in ("", "sub", "subsub") for star in ("", "*") for t in braced(block, level + "section" + star)]:
                section = _clean(titles[0])
            blocks += 1
            out.append((f"tex:block={blocks}", _clean(block), section))

    for m in _TEX_WHOLE.finditer(text):
        paragraphs(text[at : m.start()])
        at = m.end()
        if m["env"] == "abstract":
            out.append(("tex:abstract=1", _clean(m[0]), section or "Abstract"))
        else:
            tables += 1
            out.append((f"tex:table={tables}", _clean(m[0]), section))
    paragraphs(text[at:])
    return out


def _balanced(text: str, at: int, pair: str = "{}") -> int:
    """Where the group that opens at a place ends (after its closing sign); the end of the text where it does not."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in pair and text[i - 1 : i] != "\\":
            depth += 1 if text[i] == pair[0] else -1
            if not depth:
                return i + 1
    return len(text)


def _bib_entries(text: str) -> Iterator[tuple[str, str]]:
    """(key, entry) of a BibTeX file: an entry goes from a sign at the beginning of a line to the end of its braces."""
    at = 0
    while (at := text.find("@", at)) >= 0:
        brace = text.find("{", at)
        name, line = text[at + 1 : brace].strip(), text[text.rfind("\n", 0, at) + 1 : at]
        if brace < 0 or not name.isidentifier() or line.strip():
            at += 1
            continue
        end = _balanced(text, brace)
        key, comma, _ = text[brace + 1 : end].partition(",")
        if comma and len(key.split()) == 1:
            yield key.strip(), text[at:end]
        at = end


def _linked(entry: str) -> list[str]:
    """Keys that an entry's crossref and xdata fields name."""
    found, at = [], entry.find(",")
    while at >= 0 and (sign := entry.find("=", at)) >= 0:
        name = entry[at + 1 : sign].strip().lower()
        start = sign + 1 + len(entry[sign + 1 :]) - len(entry[sign + 1 :].lstrip())
        if entry[start : start + 1] == "{":
            end = _balanced(entry, start)
        elif entry[start : start + 1] == '"':
            end = entry.find('"', start + 1) + 1 or len(entry)
        else:
            end = start
        if name in ("crossref", "xdata") and end > start:
            found.append(entry[start + 1 : end - 1].strip())
        at = entry.find(",", end)
    return found


@F.pandas_udf(ArrayType(StructType([StructField("entry", StringType()), StructField("parents", ArrayType(StringType()))])))
def bib_entries(text: pd.Series) -> pd.Series:
    """Keys of a BibTeX file's entries, each with those it inherits from; comments, strings and preambles are none."""
    skipped = ("comment", "string", "preamble")
    return text.map(lambda t: [{"entry": key, "parents": _linked(entry)} for key, entry in _bib_entries(t or "") if entry[1:].split("{", 1)[0].strip().lower() not in skipped])


def _bib_items(text: str) -> Iterator[tuple[str, str]]:
    """(key, item) of a list of references: an item goes to the next one, or to the end of the list."""
    first, *rest = text.partition("\\end{thebibliography}")[0].split("\\bibitem")
    for part in rest:
        open_ = _balanced(part, 0, "[]") if part[:1] == "[" else 0
        if part[open_ : open_ + 1] == "{":
            yield part[open_ + 1 : _balanced(part, open_) - 1].strip(), "\\bibitem" + part


def parse_bibliography(data: bytes) -> list[Segment]:
    """Entries of a BibTeX file; without any, bibitems; without these, its lines."""
    text = data.decode("utf-8", "replace")
    named = [*_bib_entries(text)] or [*_bib_items(text)]
    if named:
        return [(f"bib:entry={key}", _clean(entry), "Bibliography") for key, entry in named]
    return [(f"bib:line={i}", _clean(x), "Bibliography") for i, x in enumerate(text.splitlines(), 1) if x.strip()]


def parse_plain(data: bytes) -> list[Segment]:
    return [(f"text:line={i + 1}", _clean(x), "") for i, x in enumerate(data.decode("utf-8", "replace").split("\n")) if x.strip()]


PARSERS = {"html": parse_html, "htm": parse_html, "tex": parse_tex, "bib": parse_bibliography, "bbl": parse_bibliography, "txt": parse_plain, "md": parse_plain, "csv": parse_plain, "tsv": parse_plain, "json": parse_plain}
#: Formats that are read as tables of elements.
QUERIES = {("xml", "nxml"): article_segments, ("docx",): word_segments, ("xlsx",): workbook_segments}


def segments(documents: DataFrame, closed: bool = False) -> DataFrame:
    """documents (document_id, suffix, content binary) -> segments; a failed one has a row with status and error. closed: see html_segments."""
    known = [*PARSERS, *(s for suffixes in QUERIES for s in suffixes)]
    docs = documents.select(F.col("document_id").cast("string").alias("document_id"), "suffix", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    wrong = F.when(~F.coalesce(F.col("suffix").isin(known), F.lit(False)), "unknown format").when(F.octet_length("content") > MOST_BYTES, "over the size limit")
    docs = docs.withColumn("error", wrong)
    none, good = F.lit(None).cast("string"), docs.where("error is null")
    parsers = PARSERS | {s: partial(parse_html, closed=closed) for s in ("html", "htm")}
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    found = docs.where("error is not null").select("document_id", none.alias("locator"), none.alias("text"), none.alias("section"), F.lit("failed").alias("status"), "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    rows = [(r["document_id"], *s, "ok", None) for s in parsers[r["suffix"]](r["content"])]
                except (ValueError, KeyError, RecursionError) as e:
                    rows = [(r["document_id"], None, None, None, "failed", str(e)[:200])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

    found = found.unionByName(good.where(F.col("suffix").isin([*PARSERS])).select("document_id", "suffix", "content").mapInArrow(run, SEGMENT))
    for suffixes, read in QUERIES.items():
        own = good.where(F.col("suffix").isin(*suffixes)).select("document_id", "content")
        if not own.isEmpty():
            found = found.unionByName(read(own))
    return found


def json_arrays(documents: DataFrame, record: str) -> DataFrame:
    """documents (document_id, content text) that are JSON arrays of records (DDL) -> document_id, at (from 0), record, error.

    What is no JSON, no array or an empty one has one row with an error; so has a member that is no object, in its place. Null contents are no JSON.
    """
    whole = F.try_parse_json("content")
    members = F.try_variant_get(whole, "$", "array<variant>")
    error = F.when(whole.isNull(), "no JSON").when(members.isNull(), "no array").when(F.size(members) == 0, "an empty array")
    read = documents.select("document_id", error.alias("error"), F.posexplode_outer(F.when(error.isNull(), members)).alias("at", "v"))
    held = F.from_json(F.to_json("v"), record)
    wrong = F.when(F.col("error").isNull() & ~F.to_json("v").startswith("{"), "no object").otherwise(F.col("error"))
    return read.select("document_id", "at", F.when(wrong.isNull(), held).alias("record"), wrong.alias("error"))


def files(spark: SparkSession, path: str, exclude: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """All files below a folder as document_id (path), suffix, length, sha256 and content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return f.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in exclude]))).select(F.col("path").alias("document_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), "length", F.sha2("content", 256).alias("sha256"), "content")


def verified(candidates: DataFrame, size: int, sha256: str) -> DataFrame:
    """The first candidate file, by path, whose length and hash are these."""
    return candidates.where((F.col("length") == size) & (F.col("sha256") == sha256)).orderBy("document_id").limit(1)


#: What a file's name or suffix says of its role (fixed values).
ROLES = {"supplement": r"supplement|supporting|suppl|appendix|attachment", "bibliography": r"\.(bib|bbl)$"}


def role(path: F.Column) -> F.Column:
    name = F.lower(path)
    return F.when(name.rlike(ROLES["supplement"]), "supplement").when(name.rlike(ROLES["bibliography"]), "bibliography").otherwise("main")


def locate_quotes(fields: DataFrame, segs: DataFrame) -> DataFrame:
    """fields (field_id, document_id, locator, quote): whether the quote stands in that segment; null without one."""
    s = segs.select("document_id", "locator", F.col("text").alias("_t"))
    return fields.join(s, ["document_id", "locator"], "left").select("field_id", F.when(F.col("_t").isNotNull(), F.contains("_t", "quote")).alias("found"))
