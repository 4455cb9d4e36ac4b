"""Identifiers, titles, names and other text as columns."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def compact(s: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normal_title(s: Column) -> Column:
    """Lower-cased words of letters and digits, one space apart."""
    return F.array_join(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)[^\W_]+"), F.lit(0)), " ")


def title_words(s: Column) -> Column:
    """Distinct title words; ideographs stand alone."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\p{IsHan}|(?:(?!\p{IsHan})[^\W_])+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def coverage(wanted: Column, found: Column) -> Column:
    """Share of the wanted words that are found."""
    return F.size(F.array_intersect(wanted, found)) / F.nullif(F.size(F.array_distinct(wanted)), F.lit(0))


def normal_doi(s: Column) -> Column:
    """Lower-case DOI without resolver, scheme or closing dots; null for anything else."""
    bare = F.rtrim(F.regexp_replace(F.trim(s), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), F.lit("."))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.lower(bare))


#: Prefixes that forms of a DOI may bear, and what else each reader takes off (fixed values).
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
DOI_FORMS = {
    "kernel": (DOI_PREFIX, r"\.+$"),
    "interchange": (DOI_PREFIX, ""),
    "identity": (r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*|doi\.org/)", ""),
    "locator": (DOI_PREFIX, r"^/+|/+$"),
    "works": (r"^(?:https?://doi\.org/|https://dx\.doi\.org/|doi:)", ""),
}


def bare_doi(s: Column, form: str = "kernel") -> Column:
    """The DOI as one of the readers has it: lower case, without its prefix; empty for null. Not checked for being one."""
    prefix, ends = DOI_FORMS[form]
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    t = F.trim(F.regexp_replace(t, prefix, ""))
    return F.regexp_replace(t, ends, "") if ends else t


#: Identifiers by kind: prefixes, then what must follow, and the address of one (fixed values).
IDENTIFIERS = {
    "doi": (r"https?://(?:dx\.)?doi\.org/|doi:", r"10\.\d{4,9}/\S+", "https://doi.org/", ""),
    "arxiv": (r"https?://arxiv\.org/(?:abs|pdf)/|arxiv:", r"\d{4}\.\d{4,5}(?:v\d+)?|(?i:[a-z][a-z-]*(?:\.[a-z]{2})?/\d{7}(?:v\d+)?)", "https://arxiv.org/abs/", ""),
    "pmid": (r"https?://pubmed\.ncbi\.nlm\.nih\.gov/|pmid:", r"\d{1,9}", "https://pubmed.ncbi.nlm.nih.gov/", "/"),
    "openalex": (r"https://openalex\.org/", r"[WASTCPFI]\d+", "https://openalex.org/", ""),
}


def _stripped(s: Column, ends: str = r"\s") -> Column:
    return F.regexp_replace(s, rf"(?U)^(?:{ends})+|(?:{ends})+$", "")


def identifier(s: Column) -> Column:
    """Struct of type, value and canonical address: doi, arxiv (its version kept), pmid, openalex or unknown.

    With a kind's prefix only that kind will do; without one the whole text must have its form, arxiv before doi before
    openalex before pmid. Null and empty texts are unknown.
    """
    t = _stripped(s)
    low = F.lower(t)
    values = {}
    for kind, (prefix, body, _, _) in IDENTIFIERS.items():
        has = low.rlike(f"^(?:{prefix})")
        rest = _stripped(F.regexp_replace(t, f"(?i)^(?:{prefix})", ""))
        if kind == "doi":
            rest, bare = F.regexp_replace(F.lower(rest), r"\.+$", ""), low
        elif kind == "arxiv":
            pdf = low.rlike(r"^https?://arxiv\.org/pdf/")
            rest, bare = _stripped(F.when(pdf, F.regexp_replace(F.lower(rest), r"\.pdf$", "")).otherwise(rest), "/"), t
        else:
            rest, bare = _stripped(rest, "/"), t
        if kind == "openalex":
            rest, bare = F.upper(rest), F.upper(t)
        form = f"^(?:{body})$"
        values[kind] = (has, F.when(rest.rlike(form), rest), F.when(bare.rlike(form), bare))
    prefixed = F.when(F.lit(False), F.lit(None))
    for kind, (has, value, _) in values.items():
        prefixed = prefixed.when(has, F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.alias("value"))))
    for kind in ("arxiv", "doi", "openalex", "pmid"):
        prefixed = prefixed.when(values[kind][2].isNotNull(), F.struct(F.lit(kind).alias("type"), values[kind][2].alias("value")))
    kind, value = prefixed["type"], prefixed["value"]
    address = F.lit(None)
    for k, (_, _, start, end) in IDENTIFIERS.items():
        address = F.when(kind == k, F.concat(F.lit(start), value, F.lit(end))).otherwise(address)
    return F.struct(F.coalesce(kind, F.lit("unknown")).alias("type"), value.alias("value"), address.cast("string").alias("canonical"))


#: What is taken off an identifier whose kind is given: patterns in order (fixed values).
KINDS = {
    "doi": (r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*|doi\.org/)",),
    "arxiv_id": (r"(?i)^https?://arxiv\.org/(?:abs|pdf)/", r"(?i)^arxiv:\s*", r"(?i)\.pdf$", r"(?i)v\d+$"),
    "pmid": (r"\D",),
    "pmcid": (r"(?i)^PMC\s*", r"\s"),
    "openalex_id": (r"/+$", r"^.*/"),
    "orcid": (r"(?i)^https?://orcid\.org/", r"[^0-9Xx]"),
    "isbn": (r"[^0-9Xx]",),
    "issn": (r"[^0-9Xx]",),
    "handle": (r"(?i)^https?://(?:hdl\.)?handle\.net/",),
    "url": (r"/+$",),
}
_UPPER_KINDS, _LOWER_KINDS = ("pmcid", "openalex_id", "orcid", "isbn", "issn"), ("doi", "arxiv_id")


def normal_identifier(kind: Column, value: Column) -> Column:
    """An identifier of a given kind in its one form; other kinds only without white space at their ends; null is empty."""
    t = _stripped(F.coalesce(value, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, patterns in KINDS.items():
        own = t
        for pattern in patterns:
            own = F.regexp_replace(own, pattern, "")
        own = _stripped(own)
        if name == "url":
            parts = lambda k, own=own: F.regexp_extract(own, r"(?i)^(https?)://([^/]+)(.*)$", k)
            own = F.when(parts(1) != "", F.concat(F.lower(parts(1)), F.lit("://"), F.lower(parts(2)), parts(3))).otherwise(own)
        out = out.when(kind == name, F.upper(own) if name in _UPPER_KINDS else F.lower(own) if name in _LOWER_KINDS else own)
    return out.otherwise(t)


def arxiv_version(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"(?i)(?:\d{4}\.\d{4,5}|/\d{7})v(\d+)", 1), F.lit("")).cast("int")


def dois_in(text: Column) -> Column:
    """Distinct DOIs named in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"10\.\d{4,9}/[^\s\"<>\]})]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.rtrim(x, F.lit(".,;:")))))


def year_of(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"(\d{4})", 1), F.lit("")).cast("int")


def split_name(s: Column) -> Column:
    """Struct of family and given name from `Family, Given` or `Given Family`."""
    t = compact(s)
    comma = F.instr(t, ",") > 0
    family = F.when(comma, F.trim(F.substring_index(t, ",", 1))).otherwise(F.substring_index(t, " ", -1))
    given = F.when(comma, F.trim(F.regexp_replace(t, r"^[^,]*,", ""))).otherwise(F.trim(F.regexp_replace(t, r"\S+$", "")))
    return F.struct(family.alias("family"), F.nullif(given, F.lit("")).alias("given"))


def normal_authors(names: Column) -> Column:
    """Sorted distinct names in lower case: words of ASCII letters and digits, and single ideographs, one space apart."""
    words = lambda n: F.array_join(F.regexp_extract_all(F.lower(n), F.lit("[a-z0-9]+|[\u4e00-\u9fff]"), F.lit(0)), " ")
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, words), lambda n: n != "")))


#: Words that make no citation key (fixed values).
KEY_STOP = ("the", "and", "for", "with", "from", "that", "this", "into", "using")


def citekey(authors: Column, year: Column, title: Column) -> Column:
    """familyYEARword, from the first author's first word, the year and the first title word of four letters or more."""
    family = F.regexp_replace(F.regexp_extract(F.trim(authors[0]), r"^([^,\s]*)", 1), "[^A-Za-z0-9]", "")
    words = F.filter(F.transform(F.regexp_extract_all(title, F.lit(r"[A-Za-z]{4,}"), F.lit(0)), lambda w: F.lower(w)), lambda w: ~w.isin(*KEY_STOP))
    return F.concat(F.coalesce(F.nullif(F.lower(family), F.lit("")), F.lit("anon")), F.coalesce(year.cast("string"), F.lit("nd")), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("work")))


def entry_key(family: Column, year: Column, title: Column) -> Column:
    """familyYEARword for a provider's record, from the first author's family name, the year and the title's first word."""
    name = F.regexp_replace(F.lower(family), "[^a-z0-9]", "")
    word = F.nullif(F.regexp_extract(F.lower(title), "[a-z0-9]+", 0), F.lit(""))
    return F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("anon")), F.coalesce(F.nullif(year.cast("string"), F.lit("0")), F.lit("nd")), F.coalesce(word, F.lit("untitled")))


def rebuild_abstract(index: Column) -> Column:
    """The text of an inverted index (word to positions)."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")


#: What LaTeX needs escaped (fixed values).
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex_escape(s: Column) -> Column:
    """Every special character replaced once, in one pass."""
    table = F.create_map(*[F.lit(x) for pair in TEX.items() for x in pair])
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(table[c], c)), "")


def tex_unescape(s: Column) -> Column:
    for plain, escaped in TEX.items():
        s = F.replace(s, F.lit(escaped), F.lit("\0" if plain == "\\" else plain))
    return F.replace(s, F.lit("\0"), F.lit("\\"))


def protect_acronyms(title: Column) -> Column:
    """Words of two letters or more, all capitals, in braces with their punctuation; words in braces already stay."""

    def one(token: Column) -> Column:
        core = F.regexp_replace(token, r"^[.,:;()\[\]]+|[.,:;()\[\]]+$", "")
        braced = lambda c: c.rlike(r"(?s)^(?:\{.*\}|\\\{.*\\\})$")
        capitals = (F.length(core) >= 2) & (F.upper(core) == core) & (F.lower(core) != core)
        return F.when(capitals & ~braced(token) & ~braced(core), F.concat(F.lit("{"), token, F.lit("}"))).otherwise(token)

    return F.array_join(F.transform(F.split(title, " "), one), " ")


#: Number words (fixed values); tens take a unit after a hyphen or a space.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = {w: i for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
NUMBERS |= {f"{ten}{gap}{one}": NUMBERS[ten] + NUMBERS[one] for ten in TENS for one in ONES[1:10] for gap in "- "}


def number_in(s: Column) -> Column:
    """The one number of a phrase, thousands separators allowed, or a number word; null for none or several."""
    found = F.regexp_extract_all(s, F.lit(r"[-+]?(?:\d{1,3}(?:,\s*\d{3})+(?!\d)|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?|[-+]?\.\d+"), F.lit(0))
    words = F.create_map(*[F.lit(x) for k, v in NUMBERS.items() for x in (k, float(v))])
    return F.when(F.size(found) == 1, F.regexp_replace(found[0], r",\s*", "").cast("double")).when(F.size(found) == 0, words[F.lower(compact(s))])


#: Spellings of units (fixed values).
UNITS = {
    "%": "%", "percent": "%", "percentage": "%", "pct": "%", "百分比": "%", "pp": "pp", "percentage point": "pp", "percentage points": "pp",
    "ms": "ms", "millisecond": "ms", "milliseconds": "ms", "s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s",
    "us": "us", "µs": "us", "μs": "us", "microsecond": "us", "microseconds": "us", "ns": "ns", "nanosecond": "ns", "nanoseconds": "ns",
    "mb": "mb", "mib": "mib", "gb": "gb", "gib": "gib", "kb": "kb", "kib": "kib", "gb/s": "gb/s",
    "hz": "hz", "khz": "khz", "mhz": "mhz", "ghz": "ghz", "db": "db", "x": "x", "×": "x",
}


def unit(s: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    key = F.lower(compact(s))
    return F.coalesce(table[key], key)


def target_path(s: Column) -> Column:
    """A file target without drive, line number and leading ./, slashes forward."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), r"\\", "/"), r"^[A-Za-z]:", "")
    return F.regexp_replace(F.regexp_replace(t, r":\d+(?:[-:]\d+)?$", ""), r"^(?:\./)+|^/+", "")


def issue_identity(key: Column, claim: Column) -> Column:
    """The key, or twelve hex digits of the claim's hash."""
    k = F.nullif(F.lower(F.trim(key)), F.lit(""))
    return F.coalesce(k, F.left(F.sha2(F.lower(compact(claim)), 256), F.lit(12)))


def path_class(p: Column) -> Column:
    """vendored, tests, examples, excluded or core, by the parts of a path."""
    parts = F.split(F.lower(p), "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    base = F.element_at(parts, -1)
    return F.when(has(".git", "node_modules", "__pycache__", "build", "dist", ".venv", "venv"), "excluded").when(has("vendor", "third_party", "vendored", "external"), "vendored").when(has("test", "tests") | base.rlike(r"^test_|_test\.py$"), "tests").when(has("examples", "example", "demo", "demos", "docs"), "examples").otherwise("core")


def payload(s: Column, most: int = 1 << 20) -> Column:
    """Decoded base64, null if malformed or over the budget."""
    raw = F.try_to_binary(s, F.lit("base64"))
    return F.when(F.octet_length(raw) <= most, raw)


@F.pandas_udf(StringType())
def nfc_compact(s: pd.Series) -> pd.Series:
    """Composed characters, white space runs to one space, none at the ends."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys, no blanks and plain Unicode; null for what is no JSON or holds no finite number."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False) if t is not None else None
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(StringType())
def first_json_object(s: pd.Series) -> pd.Series:
    """The first piece of a text, from an opening brace on, that is a valid JSON object; null without one."""
    decoder = json.JSONDecoder()

    def found(t: str | None) -> str | None:
        at = (t or "").find("{")
        while at >= 0:
            try:
                return t[at : decoder.raw_decode(t, at)[1]]
            except (ValueError, RecursionError):
                at = t.find("{", at + 1)
        return None

    return s.map(found)
