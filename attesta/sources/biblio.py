"""Bibliographic formats: readers to one canonical work, writers from it.

Canonical columns: key, type, title, authors array<string>, year int, container, doi, url, volume, issue, pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T

FIELDS = ("key", "type", "title", "authors", "year", "container", "doi", "url", "volume", "issue", "pages")
#: Work types of each format by canonical type (fixed values).
BIBTEX = {"article": "article", "conference": "inproceedings", "book": "book", "chapter": "incollection", "thesis": "phdthesis", "report": "techreport", "other": "misc"}
RIS = {"article": "JOUR", "conference": "CONF", "book": "BOOK", "chapter": "CHAP", "thesis": "THES", "report": "RPRT", "other": "GEN"}
CSL = {"article": "article-journal", "conference": "paper-conference", "book": "book", "chapter": "chapter", "thesis": "thesis", "report": "report", "other": "document"}


def _lookup(table: dict[str, str], x: Column, otherwise: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[x], F.lit(otherwise))


def _back(table: dict[str, str], x: Column) -> Column:
    return _lookup({v: k for k, v in table.items()}, x, "other")


def _blank(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def read_ris(texts: DataFrame) -> DataFrame:
    """texts (source, text) with TY..ER records -> canonical rows; continuation lines join the field before."""
    record = F.explode(F.filter(F.split("text", r"(?m)^ER  -.*$"), lambda r: r.rlike(r"(?m)^TY  - ")))
    r = texts.select("source", record.alias("r")).withColumn("r", F.regexp_replace("r", r"\r?\n(?![A-Z][A-Z0-9]  - )", " "))
    every = lambda tags: F.transform(F.regexp_extract_all("r", F.lit(rf"(?m)^(?:{tags})  - (.*)$"), F.lit(1)), lambda x: F.trim(x))
    one = lambda tags: F.nullif(F.get(every(tags), F.lit(0)), F.lit(""))
    first, last = one("SP"), one("EP")
    return r.select(one("ID").alias("key"), _back(RIS, one("TY")).alias("type"), one("TI|T1").alias("title"), every("AU|A1").alias("authors"), T.year_of(one("PY|Y1")).alias("year"), one("T2|JO|JF").alias("container"), T.normal_doi(one("DO")).alias("doi"), one("UR").alias("url"), one("VL").alias("volume"), one("IS").alias("issue"), F.when(last.isNotNull(), F.concat_ws("-", first, last)).otherwise(first).alias("pages"))


def to_ris(works: DataFrame) -> DataFrame:
    line = lambda tag, x: F.when(x.isNotNull(), F.concat(F.lit(f"{tag}  - "), x.cast("string")))
    c = F.col
    authors = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n")
    parts = [F.concat(F.lit("TY  - "), _lookup(RIS, c("type"), "GEN")), line("ID", c("key")), line("TI", c("title")), F.nullif(authors, F.lit("")), line("PY", c("year")), line("T2", c("container")), line("DO", c("doi")), line("UR", c("url")), line("VL", c("volume")), line("IS", c("issue")), line("SP", _blank(F.substring_index("pages", "-", 1))), line("EP", F.when(c("pages").contains("-"), _blank(F.substring_index("pages", "-", -1)))), F.lit("ER  - ")]
    return works.select("key", F.concat_ws("\n", *parts).alias("ris"))


def read_bibtex(texts: DataFrame) -> DataFrame:
    """texts (source, text) -> canonical rows. Values in braces (nested twice at most) or quotes, or bare numbers;
    no string macros and no concatenation. @comment, @preamble and @string are left out."""
    brace = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
    entry = rf"@\w+\s*\{{\s*[^,\s]+\s*,(?:[^{{}}]|{brace})*\}}"
    e = texts.select("source", F.explode(F.regexp_extract_all("text", F.lit(entry), F.lit(0))).alias("e"))
    e = e.withColumn("kind", F.lower(F.regexp_extract("e", r"^@(\w+)", 1))).where(~F.col("kind").isin("comment", "preamble", "string"))

    def field(name: str) -> Column:
        raw = F.regexp_extract("e", rf"(?is)[,\s]{name}\s*=\s*({brace}|\"[^\"]*\"|\d+)", 1)
        bare = F.regexp_replace(F.regexp_replace(raw, r'(?s)^[{"](.*)[}"]$', "$1"), r"[{}]", "")
        return T.tex_unescape(_blank(T.compact(bare)))

    authors = F.when(field("author").isNull(), F.array().cast("array<string>")).otherwise(F.split(field("author"), r"\s+and\s+"))
    return e.select(F.regexp_extract("e", r"^@\w+\s*\{\s*([^,\s]+)", 1).alias("key"), _back(BIBTEX, F.col("kind")).alias("type"), field("title").alias("title"), authors.alias("authors"), T.year_of(field("year")).alias("year"), F.coalesce(field("journal"), field("booktitle")).alias("container"), T.normal_doi(field("doi")).alias("doi"), field("url").alias("url"), field("volume").alias("volume"), field("number").alias("issue"), F.replace(field("pages"), F.lit("--"), F.lit("-")).alias("pages"))


def to_bibtex(works: DataFrame) -> DataFrame:
    c = F.col
    line = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"  {name} = {{"), x.cast("string"), F.lit("}")))
    journal, pages = c("type") == "article", F.regexp_replace("pages", r"(?<!-)-(?!-)", "--")
    parts = [line("title", T.tex_escape(c("title"))), line("author", F.nullif(T.tex_escape(F.array_join("authors", " and ")), F.lit(""))), line("year", c("year")), F.when(journal, line("journal", T.tex_escape(c("container")))).otherwise(line("booktitle", T.tex_escape(c("container")))), line("doi", c("doi")), line("url", c("url")), line("volume", c("volume")), line("number", c("issue")), line("pages", pages)]
    return works.select("key", F.concat(F.lit("@"), _lookup(BIBTEX, c("type"), "misc"), F.lit("{"), c("key"), F.lit(",\n"), F.concat_ws(",\n", *parts), F.lit("\n}")).alias("bibtex"))


_NAMES = "array<struct<family: string, given: string>>"


def read_csl(items: DataFrame) -> DataFrame:
    """items (json) of CSL -> canonical rows."""
    kind = f"id string, type string, title string, author {_NAMES}, issued struct<`date-parts`: array<array<int>>>, `container-title` string, DOI string, URL string, volume string, issue string, page string"
    j = items.select(F.from_json("json", kind).alias("j")).select("j.*")
    return j.select(F.col("id").alias("key"), _back(CSL, F.col("type")).alias("type"), "title", F.transform(F.coalesce("author", F.array().cast(_NAMES)), lambda a: F.concat_ws(", ", a["family"], a["given"])).alias("authors"), F.get(F.get(F.col("issued.date-parts"), F.lit(0)), F.lit(0)).alias("year"), F.col("container-title").alias("container"), T.normal_doi(F.col("DOI")).alias("doi"), F.col("URL").alias("url"), "volume", "issue", F.col("page").alias("pages"))


def to_csl(works: DataFrame) -> DataFrame:
    c = F.col
    key = F.coalesce(c("key"), T.citekey(c("authors"), c("year"), c("title")))
    issued = F.when(c("year").isNotNull(), F.struct(F.array(F.array(c("year"))).alias("date-parts")))
    return works.select("key", F.to_json(F.struct(key.alias("id"), _lookup(CSL, c("type"), "document").alias("type"), c("title"), F.transform("authors", lambda a: T.split_name(a)).alias("author"), issued.alias("issued"), c("container").alias("container-title"), c("doi").alias("DOI"), c("url").alias("URL"), c("volume"), c("issue"), c("pages").alias("page"))).alias("csl"))


def read_crossref(items: DataFrame) -> DataFrame:
    """items (json) of single works; the year comes from issued or published dates, never from created."""
    date = "struct<`date-parts`: array<array<int>>>"
    kind = f"message struct<DOI: string, type: string, title: array<string>, author: array<struct<family: string, given: string, name: string>>, `container-title`: array<string>, issued: {date}, `published-print`: {date}, `published-online`: {date}, URL: string, volume: string, issue: string, page: string, items: array<string>>"
    j = items.select(F.from_json("json", kind).alias("j")).where("j.message is not null and j.message.items is null").select("j.message.*")
    year = lambda x: F.get(F.get(F.col(f"`{x}`.date-parts"), F.lit(0)), F.lit(0))
    kinds = {"journal-article": "article", "proceedings-article": "conference", "book": "book", "book-chapter": "chapter", "dissertation": "thesis", "report": "report"}
    return j.select(T.normal_doi(F.col("DOI")).alias("key"), _lookup(kinds, F.col("type"), "other").alias("type"), F.get("title", F.lit(0)).alias("title"), F.transform("author", lambda a: F.coalesce(a["name"], F.concat_ws(", ", a["family"], a["given"]))).alias("authors"), F.coalesce(year("issued"), year("published-print"), year("published-online")).alias("year"), F.get("container-title", F.lit(0)).alias("container"), T.normal_doi(F.col("DOI")).alias("doi"), F.col("URL").alias("url"), "volume", "issue", F.col("page").alias("pages"))


def read_openalex(items: DataFrame) -> DataFrame:
    kind = "id string, type string, title string, publication_year int, doi string, authorships array<struct<author: struct<display_name: string>>>, primary_location struct<landing_page_url: string, source: struct<display_name: string>>, biblio struct<volume: string, issue: string, first_page: string, last_page: string>"
    j = items.select(F.from_json("json", kind).alias("j")).select("j.*")
    kinds = {"article": "article", "proceedings-article": "conference", "book": "book", "book-chapter": "chapter", "dissertation": "thesis", "report": "report"}
    return j.select(F.element_at(F.split("id", "/"), -1).alias("key"), _lookup(kinds, F.col("type"), "other").alias("type"), "title", F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("container"), T.normal_doi(F.col("doi")).alias("doi"), F.col("primary_location.landing_page_url").alias("url"), F.col("biblio.volume").alias("volume"), F.col("biblio.issue").alias("issue"), F.nullif(F.concat_ws("-", "biblio.first_page", "biblio.last_page"), F.lit("")).alias("pages"))


def booktabs(rows: DataFrame, by: str, order: str, label: str, values: list[str], digits: int = 2, best: str = "max") -> DataFrame:
    """A LaTeX table for each group: values rounded half up, the best of a column bold (all ties), after rounding."""
    w = Window.partitionBy(by)
    cells = []
    for v in values:
        x = F.round(F.col(v).cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})")
        top = (F.max if best == "max" else F.min)(x).over(w)
        cells.append(F.when(x == top, F.concat(F.lit("\\textbf{"), x.cast("string"), F.lit("}"))).otherwise(F.coalesce(x.cast("string"), F.lit("--"))))
    lines = rows.select(by, F.col(order).alias("_o"), F.concat(F.concat_ws(" & ", T.tex_escape(F.col(label).cast("string")), *cells), F.lit(" \\\\")).alias("_l"))
    body = lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda s: s["_l"]), "\n").alias("body"))
    head = f"\\begin{{tabular}}{{l{'r' * len(values)}}}\n\\toprule\n{' & '.join([label, *values])} \\\\\n\\midrule\n".replace("_", "\\_")
    return body.select(by, F.concat(F.lit(head), "body", F.lit("\n\\bottomrule\n\\end{tabular}")).alias("latex"))


def markdown_table(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """A Markdown table for each group, bars escaped."""
    cell = lambda c: F.replace(T.compact(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("|"), F.lit("\\|"))
    lines = rows.select(by, F.col(order).alias("_o"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("_l"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    return lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda s: s["_l"]), "\n").alias("b")).select(by, F.concat(F.lit(head), "b").alias("markdown"))
