"""What LaTeX and XMP need beyond patterns: masking by tokens, balanced braces, sentences, flattened metadata."""

from __future__ import annotations

import posixpath
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from attesta.functions.text import UNITS

#: Environments whose insides are no LaTeX (fixed values).
VERBATIM = ("verbatim", "verbatim*", "lstlisting", "minted", "comment")
#: What decides whether a character is text, longest first: a verbatim environment (or the rest after an open one),
#: inline verbatim, an escaped character, a comment.
_TOKENS = re.compile(
    r"(?P<env>\\begin\s*\{\s*(?P<name>" + "|".join(map(re.escape, sorted(VERBATIM, key=len, reverse=True))) + r")\s*\})(?P<inside>.*?)(?P<end>\\end\s*\{\s*(?P=name)\s*\}|\Z)"
    r"|(?P<verb>\\verb\*?(?P<mark>[^A-Za-z0-9\s*])[^\n]*?(?P=mark))"
    r"|(?P<escaped>\\.)|(?P<comment>%[^\n]*)",
    re.DOTALL,
)

#: Without any of these nothing is hidden.
_HIDES = ("%", "\\verb", "lstlisting", "minted", "comment", "verbatim")


def masked(text: str) -> str:
    """The text without comments, inline verbatim and the insides of verbatim environments; line numbers stay."""

    if not any(sign in text for sign in _HIDES):
        return text

    def kept(m: re.Match[str]) -> str:
        if m["env"]:
            return m["env"] + "\n" * m["inside"].count("\n") + m["end"]
        return m["escaped"] or ""

    return _TOKENS.sub(kept, text)


def braced(text: str, macro: str) -> list[str]:
    """Arguments of a macro, braces balanced, an optional argument passed over; unbalanced ones are left out."""
    found = []
    for m in re.finditer(re.escape("\\" + macro) + r"(?![A-Za-z])\s*(?:\[[^\]]*\]\s*)?\{", text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            if text[i] == "\\":
                i += 1
            else:
                depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        if not depth:
            found.append(text[m.end() : i - 1])
    return found


def sentence_at(text: str, at: int) -> str:
    """The sentence around a position; stops in numbers and common abbreviations end none."""
    ends = [m.end() for m in re.finditer(r"(?<!\be\.g)(?<!\bi\.e)(?<!\bal)(?<!\bFig)[.!?](?=\s|$)", text)]
    start = max((e for e in ends if e <= at), default=0)
    end = min((e for e in ends if e > at), default=len(text))
    return text[start:end].strip()


def paired_footnotes(text: str) -> list[tuple[str, str | None]]:
    """Texts of \\footnotetext with the sentence of the mark each belongs to, in order.

    A numbered text goes with the mark of its number; others, first come, first served, with unnumbered marks, and
    when these have run out with the last mark before the text; without any mark with none.
    """
    text = masked(text)
    numbered: dict[str, str] = {}
    waiting, last, out = [], None, []
    for m in re.finditer(r"\\footnote(mark|text)\s*(?:\[([^\]]*)\])?", text):
        number = (m[2] or "").strip()
        if m[1] == "mark":
            last = sentence_at(text[: m.start()] + text[m.end() :], max(0, m.start() - 1))
            if number:
                numbered[number] = last
            else:
                waiting.append(last)
        elif note := braced(text[m.start() :], "footnotetext")[:1]:
            if number in numbered:
                out.append((note[0], numbered[number]))
            else:
                out.append((note[0], waiting.pop(0) if waiting else last))
    return out


#: What a statement has for operators of LaTeX and Unicode (fixed values).
RELATIONS = {"leq": "<=", "le": "<=", "geq": ">=", "ge": ">=", "neq": "!=", "ne": "!=", "lt": "<", "gt": ">", "approx": "op_approx", "simeq": "op_approx", "sim": "op_approx", "≤": "<=", "≥": ">=", "≠": "!=", "≈": "op_approx"}
#: Macros that change only how their argument looks (fixed values).
LOOKS = frozenset("textbf textit emph texttt textrm textsf textsc textup textnormal text mbox hbox mathrm mathbf mathit mathsf mathtt underline uline small large normalsize".split())
#: Words of direction and denial, and words without weight (fixed values).
RISES = frozenset("increase increases increased increasing improve improves improved improving improvement gain gains higher faster larger greater boost boosts boosted outperform outperforms outperformed rise rises rose positive accelerate accelerates".split())
FALLS = frozenset("decrease decreases decreased decreasing reduce reduces reduced reducing reduction drop drops dropped lower slower smaller fewer worse worsen worsens worsened decline declines declined negative degrade degrades degraded".split())
DENIALS = frozenset("not no never neither without fail fails failed".split())
FILLERS = frozenset("the a an is are was were that this and".split())
_PARTS = re.compile(
    r"(?P<silent>\\(?:cite[A-Za-z*]*|[cC]?ref|autoref|eqref|pageref|label|index)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\})"
    r"|\\(?P<macro>[A-Za-z]+)\*?\s*(?P<open>\{)?|\\(?P<mark>.)|(?P<brace>[{}])|(?P<sign>[≤≥≠≈])|(?P<gap>[~$])",
    re.DOTALL,
)


def plain_statement(text: str) -> str:
    """A statement's meaning without its looks, read from left to right: relations are signs, font macros are dropped with
    their braces, citations and labels left out, any other macro stays as an operator over its argument."""
    out, closing, at = [], [], 0
    for m in _PARTS.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m["macro"]:
            name = m["macro"]
            if name in RELATIONS:
                out.append(f" {RELATIONS[name]} ")
            elif name in ("times", "pm"):
                out.append({"times": "×", "pm": "±"}[name])
            elif name in ("quad", "qquad"):
                out.append(" ")
            elif name not in LOOKS:
                out.append(f" op_{name}" + ("(" if m["open"] else " "))
            if m["open"]:
                closing.append("" if name in LOOKS or name in RELATIONS else ") ")
        elif m["mark"]:
            out.append(" " if m["mark"] in ",;:! " else m["mark"])
        elif m["brace"]:
            if m["brace"] == "{":
                closing.append("")
            elif closing:
                out.append(closing.pop())
        elif m["sign"]:
            out.append(f" {RELATIONS[m['sign']]} ")
        else:
            out.append(" ")
    bare = re.sub(r"\(\s*\)|\[\s*\]", " ", "".join([*out, text[at:]]))
    return " ".join(bare.replace("−", "-").split())


def quantities(text: str) -> list[tuple[str, str]]:
    """Signed numbers of a statement, each with the unit beside it."""
    found = re.findall(r"(?<![A-Za-z0-9.])(-?)\s*(\d+(?:\.\d+)?)\s*(percentage points?|%|×|[A-Za-zµμ]+)?", plain_statement(text))
    return [(sign + number, UNITS.get(unit.lower(), unit.lower())) for sign, number, unit in found]


def says_otherwise(claim: str, statement: str) -> bool:
    """Whether a statement differs from a claim in its numbers, or clause by clause in direction, denial or words."""

    def meaning(text: str) -> list[list[str]]:
        clauses = re.split(r"[;；]|\bwhile\b|\bwhereas\b", plain_statement(text).lower())
        words = [re.findall(r"op_[a-z0-9_]+(?:\([^()]*\))?|<=|>=|!=|[<>=]|[a-z×]+", c) for c in clauses if c.strip(" .")]
        return [["+" if w in RISES else "-" if w in FALLS else "!" if w in DENIALS else w for w in own if w not in FILLERS and w not in _UNIT_WORDS] for own in words]

    return quantities(claim) != quantities(statement) or meaning(claim) != meaning(statement)


def flattened(xml: str) -> list[tuple[str, str]]:
    """Path and value of every text and attribute of an XML packet; nothing of malformed ones."""
    try:
        root = ElementTree.fromstring(re.sub(r"<\?xpacket[^>]*\?>|<!DOCTYPE[^>]*>", "", xml or "").strip())
    except ElementTree.ParseError:
        return []
    out: list[tuple[str, str]] = []

    def walk(e: ElementTree.Element, path: str) -> None:
        path = f"{path}/{e.tag.rsplit('}', 1)[-1]}"
        out.extend((f"{path}@{k.rsplit('}', 1)[-1]}", v) for k, v in sorted(e.attrib.items()))
        if (e.text or "").strip():
            out.append((path, e.text.strip()))
        for child in e:
            walk(child, path)

    walk(root, "")
    return out


def author_leaks(text: str) -> list[str]:
    """Arguments of author macros that name someone."""
    return _named_authors(masked(text))


def _named_authors(clean: str) -> list[str]:
    names = (" ".join(re.sub(r"\\[A-Za-z]+|[{}~]", " ", a).split()) for a in braced(clean, "author"))
    return [n for n in names if n and not re.search(r"(?i)anonym|under (?:double.)?blind|submission", n)]


#: Macros that include a file: relative to the root of a bundle or else to the file they stand in, to a folder below the root, or
#: to one beside the file; and those that only show a file (fixed values).
INCLUDES = {"input": "either", "include": "either", "subfile": "either", "import": "root", "subimport": "local"}
SHOWS = ("verbatiminput", "lstinputlisting", "includegraphics", "includepdf", "inputminted")
#: Macros that refer to a label (fixed values).
REFERS = ("ref", "eqref", "autoref", "cref", "Cref", "pageref")
#: Macros whose calls lint reads, besides all that begin with cite.
READ = frozenset((*INCLUDES, *SHOWS, *REFERS, "documentclass", "usepackage", "section", "subsection", "paragraph", "nocite", "label", "bibitem", "bibliography", "addbibresource", "thanks", "begin"))
_MACRO = re.compile(r"\\([A-Za-z@]+)(\*?)")
_SPACE = re.compile(r"\s*")


def _group(text: str, at: int) -> int:
    """The end of the bracket or brace group that opens at a place, after its closing sign; 0 where it does not end."""
    braces, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            braces += 1
        elif c == "}":
            braces -= 1
            if not braces and text[at] == "{":
                return i + 1
        elif c == "]" and not braces and text[at] == "[":
            return i + 1
        i += 1
    return 0


def calls(text: str) -> list[dict]:
    """Calls of the macros in READ and of citations, in order: line, name, options in brackets, arguments in braces. An input without
    braces takes the word after it, or what stands in quotes. Groups that do not end are none."""
    found, line, seen = [], 1, 0
    for m in _MACRO.finditer(text):
        if m[1] not in READ and not m[1].startswith("cite"):
            continue
        line, seen = line + text.count("\n", seen, m.start()), m.start()
        at, options, args = m.end(), [], []
        while True:
            start = _SPACE.match(text, at).end()
            if text[start : start + 1] not in ("{", "[") or (text[start] == "[" and args) or not (end := _group(text, start)):
                break
            (options if text[start] == "[" else args).append(text[start + 1 : end - 1])
            at = end
        if not args and m[1] in ("input", "include") and (bare := re.match(r'\s*(?:"([^"]+)"|([^\s\\{}%"\[]+))', text[at:])):
            args = [bare[1] or bare[2]]
        found.append({"line": line, "name": m[1], "options": options, "args": args})
    return found


def _reached(folder: str, name: str) -> str | None:
    """A path below the root, plain; None where it leaves the root."""
    way = posixpath.normpath(posixpath.join(folder, name))
    return None if way == ".." or way.startswith(("../", "/")) or re.match("[A-Za-z]:|\\\\", name) else way


def included(path: str, call: dict) -> dict | None:
    """What a call includes or shows: name as written, and its paths from the root and from beside the file at `path`, each None where it leaves
    the root or is not asked for; tex: whether it is read as LaTeX."""
    name, args = call["name"], [a.strip() for a in call["args"]]
    if name in INCLUDES and args and args[0]:
        where = INCLUDES[name]
        target = args[0] if where == "either" else posixpath.join(args[0], args[1]) if len(args) > 1 and not args[1].startswith("/") else "/"
        target = target if target.lower().endswith(".tex") else target + ".tex"
        beside = posixpath.dirname(path)
        return {"target": target, "root": _reached("", target) if where != "local" else None, "local": _reached(beside, target) if where != "root" else None, "tex": True}
    if name in SHOWS and len(args) > (name == "inputminted"):
        target = args[name == "inputminted"]
        return {"target": target, "root": _reached("", target), "local": _reached(posixpath.dirname(path), target), "tex": False}
    return None


#: Units are compared with their numbers.
_UNIT_WORDS = frozenset(w for u in UNITS for w in u.split())
_PAIR = StructType([StructField("path", StringType()), StructField("value", StringType())])


@F.pandas_udf(StringType())
def mask_tex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else masked(t))


@F.pandas_udf(ArrayType(StringType()))
def tex_authors(text: pd.Series) -> pd.Series:
    return text.map(lambda t: author_leaks(t or ""))


@F.pandas_udf(ArrayType(_PAIR))
def xmp_pairs(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: [{"path": p, "value": v} for p, v in flattened(x)])


@F.pandas_udf(StringType())
def sentence_around(text: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else sentence_at(t, int(i)) for t, i in zip(text, at, strict=True)], dtype=object)


_NOTE = StructType([StructField("note", StringType()), StructField("sentence", StringType())])


@F.pandas_udf(ArrayType(_NOTE))
def footnotes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"note": n, "sentence": s} for n, s in paired_footnotes(t or "")])


@F.pandas_udf(BooleanType())
def diverges(claim: pd.Series, statement: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else says_otherwise(a, b) for a, b in zip(claim, statement, strict=True)], dtype=object)


_CALL = StructType([StructField("line", IntegerType()), StructField("name", StringType()), StructField("options", ArrayType(StringType())), StructField("args", ArrayType(StringType())), StructField("includes", StructType([StructField("target", StringType()), StructField("root", StringType()), StructField("local", StringType()), StructField("tex", BooleanType())]))])


@F.pandas_udf(StructType([StructField("clean", StringType()), StructField("calls", ArrayType(_CALL)), StructField("authors", ArrayType(StringType()))]))
def lexed(path: pd.Series, text: pd.Series) -> pd.DataFrame:
    """All that lint reads of a file, in one pass: its masked text, its calls and whom it names as authors."""
    rows = []
    for p, t in zip(path, text, strict=True):
        clean = masked(t or "")
        rows.append((None if t is None else clean, [{**c, "includes": included(p or "", c)} for c in calls(clean)], _named_authors(clean)))
    return pd.DataFrame(rows, columns=["clean", "calls", "authors"])
