"""JSON Schemas compiled to one column expression over VARIANT: the findings of a document as an array of (path, rule).

Keywords: type, enum, const, required, properties, additionalProperties, patternProperties, propertyNames,
minProperties, maxProperties, items, minItems, maxItems, uniqueItems, minLength, maxLength, pattern, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, $ref into this or another given document, allOf, anyOf, oneOf, not, if, then, else. Others are notes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDINGS = "array<struct<path:string,rule:string>>"
#: What the JSON of a value begins with, by type.
_BEGINS = {"object": "{", "array": "[", "string": '"', "boolean": "tf", "null": "n", "number": "-0123456789"}


def _none() -> Column:
    return F.array().cast(FINDINGS)


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _say(broken: Column, path: Column, rule: str | Column) -> Column:
    rule = rule if isinstance(rule, Column) else F.lit(rule)
    return F.when(broken, F.array(F.struct(path.alias("path"), rule.alias("rule")))).otherwise(_none())


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "<root>", name).otherwise(F.concat(path, F.lit("/"), name))


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _being(text: Column, kind: str) -> Column:
    """Whether a JSON text is of a type, by its first sign."""
    begins = F.left(text, F.lit(1))
    return begins == _BEGINS[kind] if len(_BEGINS[kind]) == 1 else begins.isin(*_BEGINS[kind])


#: Keywords that need a value's number, its string, its items, and its members (fixed values).
_OF_NUMBERS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "enum", "const"}
_OF_STRINGS = {"minLength", "maxLength", "pattern"}
_OF_ARRAYS = {"items", "minItems", "maxItems", "uniqueItems"}
_OF_OBJECTS = {"required", "properties", "patternProperties", "additionalProperties", "propertyNames", "minProperties", "maxProperties"}


class _Compiler:
    """most_refs: how often one way down the schema may pass through references, so that a recursive schema ends; others: the
    schemas that references name, by the last part of their names."""

    def __init__(self, root: dict[str, Any], most_refs: int, others: dict[str, dict[str, Any]]):
        self.root, self.most_refs, self.others = root, most_refs, others

    def referred(self, v: Column, path: Column, ref: str, refs: int) -> Column:
        name, _, way = ref.partition("#")
        inside = self if not name else _Compiler(self.others[name.rsplit("/", 1)[-1]], self.most_refs, self.others)
        at: Any = inside.root
        for part in way.strip("/").split("/") if way.strip("/") else ():
            at = at[part.replace("~1", "/").replace("~0", "~")] if isinstance(at, dict) else at[int(part)]
        return inside.check(v, path, at, refs)

    def check(self, v: Column, path: Column, schema: Any, refs: int = 0) -> Column:
        """The findings of a value that is there."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return _say(F.lit(True), path, "false")
        return _let(F.struct(v.alias("v"), path.alias("path"), F.to_json(v).alias("text")), lambda x: _let(self.facts(x, schema), lambda y: self.judged(y, schema, refs)))

    def facts(self, x: Column, schema: dict[str, Any]) -> Column:
        """What a value is asked for, each worked out once, and only where the schema speaks of it and the value is of its type: a
        cast of a value that is none of these is dear, as it fails by an exception."""
        out = [x[c].alias(c) for c in ("v", "path", "text")]
        get = lambda name, kind, type_: out.append(F.when(_being(x["text"], kind), F.try_variant_get(x["v"], "$", type_)).alias(name))
        kinds = schema.get("type", ())
        if _OF_NUMBERS & schema.keys() or "integer" in ([kinds] if isinstance(kinds, str) else kinds):
            get("number", "number", "double")
        if _OF_STRINGS & schema.keys():
            get("string", "string", "string")
        if _OF_ARRAYS & schema.keys():
            get("items", "array", "array<variant>")
        if _OF_OBJECTS & schema.keys():
            get("members", "object", "map<string,variant>")
        return F.struct(*out)

    def judged(self, x: Column, schema: dict[str, Any], refs: int) -> Column:
        v, path, text = x["v"], x["path"], x["text"]
        being = {kind: _being(text, kind) for kind in _BEGINS}
        number, string = x["number"], x["string"]
        being["integer"] = being["number"] & (number == F.floor(number))
        out: list[Column] = []
        say = lambda broken, rule: out.append(_say(F.coalesce(broken, F.lit(False)), path, rule))
        only = lambda kind, found: out.append(F.when(being[kind], found).otherwise(_none()))
        valid = lambda sub: F.size(self.check(v, path, sub, refs)) == 0
        same = lambda x: (text == F.to_json(F.parse_json(F.lit(json.dumps(x))))) if isinstance(x, bool) or not isinstance(x, (int, float)) else being["number"] & (number == float(x))
        either = lambda xs: reduce(Column.__or__, xs, F.lit(False))
        if "$ref" in schema:
            if refs >= self.most_refs:
                say(F.lit(True), "$ref")
            else:
                out.append(self.referred(v, path, schema["$ref"], refs + 1))
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            say(~either([being[k] for k in kinds]), "type")
        if "enum" in schema:
            say(~either([same(x) for x in schema["enum"]]), "enum")
        if "const" in schema:
            say(~same(schema["const"]), "const")
        for name, test in self.bounds(x).items():
            if name in schema:
                kind, broken = test(schema[name])
                say(being[kind] & broken, name)
        if _OF_OBJECTS & schema.keys():
            self.object(x["members"], path, schema, refs, only)
        items = schema.get("items")
        if isinstance(items, dict | bool):
            only("array", F.flatten(F.transform(x["items"], lambda e, i: self.check(e, _below(path, i.cast("string")), items, refs))))
        for sub in schema.get("allOf", ()):
            out.append(self.check(v, path, sub, refs))
        if "anyOf" in schema:
            say(~either([valid(s) for s in schema["anyOf"]]), "anyOf")
        if "oneOf" in schema:
            say(reduce(Column.__add__, [valid(s).cast("int") for s in schema["oneOf"]]) != 1, "oneOf")
        if "not" in schema:
            say(valid(schema["not"]), "not")
        if "if" in schema and ("then" in schema or "else" in schema):
            out.append(F.when(valid(schema["if"]), self.check(v, path, schema.get("then", True), refs)).otherwise(self.check(v, path, schema.get("else", True), refs)))
        return _all(out)

    def bounds(self, x: Column) -> dict[str, Callable[[Any], tuple[str, Column]]]:
        string, number, items = x["string"], x["number"], x["items"]
        keys = F.map_keys(x["members"])
        return {
            "minLength": lambda n: ("string", F.length(string) < n), "maxLength": lambda n: ("string", F.length(string) > n), "pattern": lambda p: ("string", ~string.rlike(p)),
            "minimum": lambda n: ("number", number < n), "maximum": lambda n: ("number", number > n), "exclusiveMinimum": lambda n: ("number", number <= n), "exclusiveMaximum": lambda n: ("number", number >= n),
            "minItems": lambda n: ("array", F.size(items) < n), "maxItems": lambda n: ("array", F.size(items) > n),
            "uniqueItems": lambda on: ("array", F.lit(bool(on)) & (F.size(F.array_distinct(F.transform(items, lambda e: F.to_json(e)))) < F.size(items))),
            "minProperties": lambda n: ("object", F.size(keys) < n), "maxProperties": lambda n: ("object", F.size(keys) > n),
        }

    def object(self, members: Column, path: Column, schema: dict, refs: int, only: Callable[[str, Column], None]) -> None:
        """What concerns the members of an object."""
        for name in schema.get("required", ()):
            only("object", _say(~F.array_contains(F.map_keys(members), name), path, f"required:{name}"))
        known: dict[str, Any] = schema.get("properties", {})
        for name, sub in known.items():
            child = F.try_element_at(members, F.lit(name))
            only("object", F.when(child.isNotNull(), self.check(child, _below(path, F.lit(name)), sub, refs)).otherwise(_none()))
        by_pattern: dict[str, Any] = schema.get("patternProperties", {})
        entries = F.map_entries(members)
        each = lambda entries, sub: F.flatten(F.transform(entries, lambda e: self.check(e["value"], _below(path, e["key"]), sub, refs)))
        fits = lambda pattern: lambda e: e["key"].rlike(pattern)
        for pattern, sub in by_pattern.items():
            only("object", each(F.filter(entries, fits(pattern)), sub))
        more = schema.get("additionalProperties", True)
        if more is not True:
            free = lambda e: ~F.array_contains(_names(list(known)), e["key"]) & ~reduce(Column.__or__, [e["key"].rlike(p) for p in by_pattern], F.lit(False))
            extra = F.filter(entries, free)
            only("object", F.transform(extra, lambda e: F.struct(path.alias("path"), F.concat(F.lit("additionalProperties:"), e["key"]).alias("rule"))) if more is False else each(extra, more))
        if "propertyNames" in schema:
            only("object", F.flatten(F.transform(F.map_keys(members), lambda k: self.check(k.cast("variant"), _below(path, k), schema["propertyNames"], refs))))


def findings(document: Column, schema: dict[str, Any], others: dict[str, dict[str, Any]] | None = None, most_refs: int = 8) -> Column:
    """document (JSON text) -> array of (path, rule) in which it breaks the schema; a text that is no JSON breaks `json`, null gives null.

    Paths name members and places (from 0) with slashes between, `<root>` for the document. References that lead round more
    than most_refs times break `$ref`, rather than pass unseen.
    """
    judge = _Compiler(schema, most_refs, others or {})
    told = lambda v: F.when(v.isNull(), _say(F.lit(True), F.lit("<root>"), "json")).otherwise(judge.check(v, F.lit("<root>"), schema))
    return F.when(document.isNotNull(), _let(F.try_parse_json(document), told))


def validate(documents: DataFrame, column: str, schemas: dict[str, dict[str, Any]], kind: str) -> DataFrame:
    """documents with a JSON column and a column that says of which kind each is -> its other columns, path and rule, a row a finding.

    Each document goes by the schema of its kind, whose references may name the others; kinds without one break `kind`.
    """
    out = F.when(F.lit(False), _none())
    for name, schema in schemas.items():
        out = out.when(F.col(kind) == name, findings(F.col(column), schema, schemas))
    found = documents.withColumn("_f", out.otherwise(_say(F.lit(True), F.lit("<root>"), "kind")))
    return found.select(*[c for c in documents.columns if c != column], F.explode("_f").alias("_f")).select("*", "_f.path", "_f.rule").drop("_f")
