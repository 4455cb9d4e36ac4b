"""XML documents as tables of elements, and articles, word processor files and workbooks as queries over these.

Python only turns one document's tags into rows, a piece of the file at a time: an element of a name that is asked for has its place, its
parent, its name and attributes, the text in it and the places of those it stands in. What makes a segment, its address and its section is
said by joins, windows and aggregates.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, islice
from typing import BinaryIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.store import written

MOST_MEMBERS, MOST_EXPANDED = 10_000, 48 << 20
NODE = "document_id string, member string, at int, parent int, tag string, attrs map<string,string>, words string, full boolean, inside array<struct<at:int,parent:int,tag:string>>, error string"
_INSIDE = pa.list_(pa.struct([("at", pa.int32()), ("parent", pa.int32()), ("tag", pa.string())]))
_NODE = pa.schema([("document_id", pa.string()), ("member", pa.string()), ("at", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("words", pa.string()), ("full", pa.bool_()), ("inside", _INSIDE), ("error", pa.string())])
#: Rows handed on at once, and bytes of a file read at once.
PIECE, READ = 5_000, 1 << 16
PLACE = ["document_id", "member", "at"]


def _refused(*_: object) -> None:
    raise ValueError("entities are not allowed")


def _parser() -> expat.XMLParserType:
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.EntityDeclHandler = _refused
    return parser


#: A file's bytes, or what opens it.
File = bytes | Callable[[], BinaryIO]


def _read(data: File) -> Iterator[bytes]:
    with data() if callable(data) else io.BytesIO(data) as f:
        while piece := f.read(READ):
            yield piece


def _pieces(parser: expat.XMLParserType, data: File) -> Iterator[None]:
    try:
        for piece in _read(data):
            yield parser.Parse(piece, False)
        yield parser.Parse(b"", True)
    except expat.ExpatError as e:
        raise ValueError(f"malformed XML: {e}") from e


def checked(data: File) -> File:
    """The same, if it is well-formed and declares no entity."""
    for _ in _pieces(_parser(), data):
        pass
    return data


def rows_of(data: File, wanted: dict[str, tuple[str | None, str | None]]) -> Iterator[tuple]:
    """(at, parent, tag, attributes, words, full, inside) of a document's root and its elements of the wanted names, each as it ends;
    names without prefix. at counts elements and texts from 1.

    wanted: name -> what stands between texts (None: none is kept), and the name of the elements whose own texts count (None:
    of all). full: whether any text is more than blanks and soft hyphens; inside: the wanted elements around it, outermost first.
    """
    out, path, held, n, going = [], [], [], 0, False
    local = lambda name: name.rsplit(":", 1)[-1]

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal n, going
        n, going, tag, own = n + 1, False, local(name), None
        parent = path[-1][0] if path else None
        if tag in wanted or not path:
            # an attribute without prefix goes before one of the same name with one
            named = {local(k): v for k, v in attrs.items() if ":" in k} | {k: v for k, v in attrs.items() if ":" not in k}
            own = [n, parent, tag, list(named.items()), [], False, [(e[0], e[1], e[2]) for e in held]]
            held.append(own)
        path.append((n, tag, own))

    def end(_: str) -> None:
        nonlocal going
        going = False
        own = path.pop()[2]
        if own:
            held.pop()
            gap = wanted.get(own[2], (None, None))[0]
            own[4] = gap.join(own[4]) if own[4] and gap is not None else None
            out.append(tuple(own))

    def text(said: str) -> None:
        nonlocal n, going
        n += not going  # a text that goes on in the next piece of the file is one
        tag, more = path[-1][1], bool(said.replace("\xad", "").strip())
        for own in held:
            gap, only = wanted.get(own[2], (None, None))
            own[5] = own[5] or more
            if gap is None or (only and only != tag):
                continue
            if going:
                own[4][-1] += said
            else:
                own[4].append(said)
        going = True

    parser = _parser()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    for _ in _pieces(parser, checked(data)):
        yield from out
        out.clear()


def nodes(documents: DataFrame, wanted: dict[str, tuple[str | None, str | None]], parts: str | None = None, most_expanded: int | None = MOST_EXPANDED) -> DataFrame:
    """documents (document_id, content) -> NODE rows of each document or, with parts, of the members of each archive whose names fit that
    pattern. What cannot be read has one row, with its error: a member that is malformed, an archive over its limits, with a
    member outside its root, or that is none. Members are read in pieces; most_expanded: bytes of all of them, None for
    archives that are trusted."""
    fits = re.compile(parts) if parts else None

    def members(data: bytes) -> Iterator[tuple[str, File]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            known = z.infolist()
            if len(known) > MOST_MEMBERS or (most_expanded is not None and sum(m.file_size for m in known) > most_expanded):
                raise ValueError("archive over its limits")
            if any(leaves_root(m.filename) for m in known):
                raise ValueError("archive member outside its root")
            yield from ((m.filename, partial(z.open, m)) for m in known if fits.search(m.filename))

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        failed = lambda member, e: (name, member, *[None] * 7, str(e)[:200])
        if fits:
            try:
                found = 0
                for _, data in members(content):  # all of them are read once before any is told of
                    found += 1
                    for _ in _read(data):
                        pass
                if not found:
                    raise ValueError("no such part")
            except (ValueError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                yield failed(None, e)
                return
        for member, data in members(content) if fits else [("", content)]:
            try:
                yield from ((name, member, *r, None) for r in rows_of(data, wanted))
            except ValueError as e:
                yield failed(member, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = chain.from_iterable(rows(name.as_py(), content.as_py() or b"") for name, content in zip(batch.column("document_id"), batch.column("content"), strict=True))
            while some := list(islice(found, PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _NODE, strict=True)], schema=_NODE)

    return documents.select("document_id", "content").mapInArrow(run, NODE)


def leaves_root(name: str) -> bool:
    """Whether a member's name is absolute, has a drive or goes up."""
    way = name.replace("\\", "/")
    return way.startswith("/") or bool(re.match("[A-Za-z]:", way)) or ".." in way.split("/")


def clean(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(s, F.lit("­"), F.lit("")), r"(?U)\s+", " "))


def _in_order(value: Column, at: Column, gap: str) -> Column:
    """Aggregate: the values of one element in order of their places."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("v")))), lambda x: x["v"]), gap)


def _elements(tree: DataFrame, tag: str) -> DataFrame:
    return tree.where(F.col("tag") == tag).select(*PLACE, "parent", "attrs")


def _words(rows: DataFrame, keys: list[str], gap: str, *kept: str) -> DataFrame:
    """rows (keys, at, words, kept) -> by the keys: their words in order of at, nulls left out, and of each kept column the greatest."""
    said = F.collect_list(F.when(F.col("words").isNotNull() & F.col("at").isNotNull(), F.struct("at", "words")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(said), lambda x: x["words"]), gap).alias("words"), *[F.max(c).alias(c) for c in kept])


def _blocks(told: DataFrame, *kept: str) -> DataFrame:
    """told (document_id, block, piece, at, words, tag, id, kept) -> document_id, at, tag, id, words, kept: pieces with their cells' words
    with bars between, blocks with their pieces' words with semicolons between."""
    lines = _words(told, ["document_id", "block", "piece"], " | ", "tag", "id", *kept).withColumnRenamed("piece", "at")
    lines = lines.withColumn("words", F.when(F.col("at").isNotNull(), F.col("words")))
    return _words(lines, ["document_id", "block"], " ; ", "tag", "id", *kept).withColumnRenamed("block", "at")


def _part(block: Column, piece: Column, words: Column, own: bool = False) -> Column:
    """What an element adds to a block: its place there and its words; own: it is the block itself."""
    none = F.lit(None).cast("string")
    return F.struct(block.alias("block"), piece.alias("piece"), F.col("at").alias("at"), words.alias("words"), (F.col("tag") if own else none).alias("tag"), (F.col("attrs")["id"] if own else none).alias("id"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("document_id", "locator", "text", "section", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))


def _failed(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("document_id", none.alias("locator"), none.alias("text"), none.alias("section"), F.lit("failed").alias("status"), "error")


#: Names of elements that become segments of an article, and the pieces of a table (fixed values).
ARTICLE = ("p", "table-wrap", "supplementary-material", "article-title")
TABLE_PIECES = ("label", "caption", "table-wrap-foot", "tr")


def article_segments(documents: DataFrame) -> DataFrame:
    """documents (document_id, content) of journal articles -> segments: paragraphs, tables, supplements and titles, each under the
    title before it, named by its id or its number. What is no article with a body of some text fails."""
    plain = [x for x in (*ARTICLE, "title") if x != "table-wrap"]
    wanted = {x: ("", None) for x in plain} | {x: (" ", None) for x in (*TABLE_PIECES, "td", "th") if x != "tr"} | {x: (None, None) for x in ("table-wrap", "tr", "body", "article")}
    none, at, tag, said = F.lit(None), F.col("at"), F.col("tag"), clean(F.coalesce("words", F.lit("")))
    wraps = lambda piece, words: F.transform(F.filter("inside", lambda x: x["tag"] == "table-wrap"), lambda x: _part(x["at"], piece, words))
    above = F.try_element_at("inside", F.lit(-1))
    parts = (
        F.when(tag.isin(plain), F.array(_part(at, at, said, True))).when(tag == "table-wrap", F.array(_part(at, none.cast("int"), none.cast("string"), True))).when(tag == "tr", wraps(at, none.cast("string")))
        .when(tag.isin("td", "th") & (above["tag"] == "tr") & (above["at"] == F.col("parent")), wraps(F.col("parent"), said)).when(tag.isin(*TABLE_PIECES), wraps(at, said))
    )
    tree = nodes(documents, wanted).select("document_id", parts.alias("parts"), F.coalesce((tag == "article") & F.col("parent").isNull(), F.lit(False)).alias("root"), F.coalesce((tag == "body") & F.col("full"), F.lit(False)).alias("body"), "error")
    # a document's rows stay together from here on: one exchange
    told = tree.where("root or body or error is not null or parts is null or size(parts) > 0").select("document_id", F.explode_outer("parts").alias("p"), "root", "body", "error").repartition("document_id").select("document_id", "p.*", "root", "body", "error")
    whole, before = Window.partitionBy("document_id"), Window.partitionBy("document_id").orderBy("at")
    rows = _blocks(told, "root", "body", "error")
    rows = rows.withColumn("good", F.max("root").over(whole) & F.max("body").over(whole)).withColumn("error", F.max("error").over(whole))
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(tag == "title", F.col("words")), ignorenulls=True).over(before), F.lit("")))
    rows = rows.withColumn("n", F.count(F.when(tag != "title", 1)).over(before)).withColumn("first", F.row_number().over(before) == 1)
    rows = rows.where((F.col("good") & (tag != "title")) | (~F.col("good") & F.col("first")))
    name = F.coalesce(F.concat(F.lit("xml:id="), F.nullif("id", F.lit(""))), F.concat(F.lit("xml:block="), "n"))
    good = lambda c: F.when(F.col("good"), c)
    return rows.select("document_id", good(name).alias("locator"), good(clean(F.col("words"))).alias("text"), good(F.col("section")).alias("section"), F.when(F.col("good"), "ok").otherwise("failed").alias("status"), F.when(~F.col("good"), F.coalesce("error", F.lit("no article with a body"))).alias("error"))


def word_segments(documents: DataFrame, most_expanded: int | None = MOST_EXPANDED) -> DataFrame:
    """documents (document_id, content) of a word processor -> segments: paragraphs with text, those in tables too, numbered, then tables whole;
    what cannot be read fails, in a row with its error. most_expanded: as in nodes."""
    wanted = {"p": ("", "t"), "tc": (" ", "t"), "tr": (None, None), "tbl": (None, None)}
    none, at, tag, said = F.lit(None), F.col("at"), F.col("tag"), clean(F.coalesce("words", F.lit("")))
    above, over = F.try_element_at("inside", F.lit(-1)), F.try_element_at("inside", F.lit(-2))
    stands = lambda x, name, parent: F.coalesce((x["tag"] == name) & (x["at"] == parent), F.lit(False))
    part = (
        F.when(tag == "p", _part(at, at, said, True)).when(tag == "tbl", _part(at, none.cast("int"), none.cast("string"), True)).when((tag == "tr") & stands(above, "tbl", F.col("parent")), _part(above["at"], at, none.cast("string")))
        .when((tag == "tc") & stands(above, "tr", F.col("parent")) & stands(over, "tbl", above["parent"]), _part(over["at"], above["at"], said))
    )
    told = nodes(documents, wanted, r"^word/document\.xml$", most_expanded).select("document_id", part.alias("p"), "error").where("p is not null or error is not null").select("document_id", "p.*", "error")
    rows = _blocks(told, "error").where("tag = 'tbl' or words <> '' or error is not null").withColumn("n", F.row_number().over(Window.partitionBy("document_id", "tag").orderBy("at")))
    known = F.col("error").isNull()
    name = F.concat(F.lit("docx:"), F.when(tag == "p", "paragraph").otherwise("table"), F.lit("="), F.col("n").cast("string"))
    return rows.select("document_id", F.when(known, name).alias("locator"), F.when(known, clean(F.col("words"))).alias("text"), F.when(known, "").alias("section"), F.when(known, "ok").otherwise("failed").alias("status"), "error")


def workbook_segments(documents: DataFrame, most_expanded: int | None = MOST_EXPANDED) -> DataFrame:
    """documents (document_id, content) of workbooks -> a segment for every row with cells, by sheet and row: cells as address=value,
    with the formula where a value is only its cached result. most_expanded: as in nodes.

    Sheets find their parts by the workbook's relations, cells their shared strings by number: joins, as the format has it. A
    workbook fails as a whole where one of these leads nowhere.
    """
    wanted = {"si": ("", None), "c": ("", "t"), "v": ("", None), "f": ("", None)} | {x: (None, None) for x in ("Relationship", "sheet", "row")}
    tree = written(nodes(documents, wanted, r"^xl/(?:workbook\.xml|_rels/workbook\.xml\.rels|sharedStrings\.xml|.*\.xml)$", most_expanded).drop("full", "inside"), "nodes")
    attr = lambda name: F.col("attrs")[name]
    targets = _elements(tree, "Relationship").where("member = 'xl/_rels/workbook.xml.rels'").select("document_id", attr("Id").alias("rid"), attr("Target").alias("target"))
    sheets = _elements(tree, "sheet").where("member = 'xl/workbook.xml'").select("document_id", attr("name").alias("sheet"), attr("id").alias("rid")).join(targets, ["document_id", "rid"], "left")
    sheets = sheets.withColumn("member", F.when(F.col("target").startswith("/"), F.ltrim(F.col("target"), F.lit("/"))).otherwise(F.concat(F.lit("xl/"), "target")))
    told = tree.groupBy("document_id").agg(F.max("error").alias("error"), *[F.max(F.col("member") == m).alias(c) for c, m in (("book", "xl/workbook.xml"), ("rels", "xl/_rels/workbook.xml.rels"))])
    bare = told.where("error is null and not (book and rels)").select("document_id", F.lit("no workbook").alias("error"))
    there = tree.select("document_id", "member", F.lit(True).alias("there")).distinct()
    lacks = F.when(F.array_contains(F.split("member", "/"), ".."), "a sheet outside the archive").when(F.col("there").isNull(), "a sheet without its part").when(F.col("sheet").isNull(), "a sheet without a name")
    lost = sheets.join(there, ["document_id", "member"], "left").select("document_id", lacks.alias("error"))
    bad = tree.select("document_id", "error").unionByName(bare).unionByName(lost).where("error is not null").groupBy("document_id").agg(F.max("error").alias("error"))
    tree = tree.join(bad, "document_id", "left_anti")
    said = clean(F.coalesce("words", F.lit("")))
    item = tree.where("tag = 'si' and member = 'xl/sharedStrings.xml'")
    strings = item.select("document_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("at")) - 1).cast("long").alias("number"), said.alias("shared"))
    lines = _elements(tree, "row").join(sheets, ["document_id", "member"]).select(*PLACE, "sheet", attr("r").alias("row"))
    # a cell with its value and its formula, which stand right in it
    of = lambda name, value: F.max(F.when(F.col("tag") == name, value))
    cells = tree.where("tag in ('c', 'v', 'f')").groupBy("document_id", "member", F.when(F.col("tag") == "c", F.col("at")).otherwise(F.col("parent")).alias("cell")).agg(
        of("c", F.col("parent")).alias("at"), of("c", attr("r")).alias("address"), of("c", attr("t")).alias("kind"), of("c", said).alias("inline"), of("v", F.col("words")).alias("value"), of("f", F.col("words")).alias("formula")
    )
    number = F.when(F.col("kind") == "s", F.expr("try_cast(value as bigint)"))
    cells = cells.join(lines, PLACE).withColumn("number", number).join(strings, ["document_id", "number"], "left")
    wrong = F.when(F.expr("kind = 's' and value <> '' and shared is null"), "a shared string that is not there").when(F.col("row").isNull(), "a row without its number")
    value = F.coalesce(F.when(F.col("kind") == "s", F.col("shared")).when(F.col("kind") == "inlineStr", F.col("inline")).otherwise(F.col("value")), F.lit(""))
    said = F.concat(F.coalesce("address", F.lit("?")), F.lit("="), value, F.coalesce(F.concat(F.lit(" [formula="), "formula", F.lit("; cached value only]")), F.lit("")))
    rows = written(cells.groupBy(*PLACE, "sheet", "row").agg(_in_order(said, F.col("cell"), " | ").alias("text"), F.max(wrong).alias("error")), "rows")
    late = rows.where("error is not null").groupBy("document_id").agg(F.max("error").alias("error"))
    rows = rows.drop("error").join(late, "document_id", "left_anti")
    return _told(rows.withColumn("locator", F.concat(F.lit("xlsx:sheet="), "sheet", F.lit(":row="), "row")).withColumn("section", F.col("sheet"))).unionByName(_failed(bad.unionByName(late)))
