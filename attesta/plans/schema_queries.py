"""Documents made from every event and order against schemas of their kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import schema as S
from attesta.plans.registry import query
from attesta.store import spread, table

SCHEMAS = {
    "event": {
        "type": "object", "required": ["id", "type", "value", "user"], "additionalProperties": False, "minProperties": 5,
        "properties": {
            "id": {"type": "integer", "minimum": 0}, "type": {"enum": ["click", "view", "purchase"]}, "value": {"type": "number", "exclusiveMaximum": 90}, "user": {"type": "string", "pattern": "^u-[0-9]{1,2}$", "maxLength": 4},
            "props": {"$ref": "#/$defs/props"}, "spare": {"not": {"type": "string"}},
        },
        "$defs": {"props": {"type": ["object", "null"], "properties": {"k": {"type": "integer", "maximum": 60}}, "propertyNames": {"maxLength": 1}}},
    },
    "order": {
        "type": "object", "required": ["status", "lines"], "if": {"properties": {"status": {"const": "F"}}}, "then": {"required": ["closed"]}, "else": {"not": {"required": ["closed"]}},
        "properties": {
            "lines": {"type": "array", "minItems": 2, "uniqueItems": True, "items": {"oneOf": [{"type": "integer", "maximum": 500}, {"type": "string", "minLength": 6}]}}, "price": {"anyOf": [{"type": "null"}, {"type": "number", "minimum": 1000, "maximum": 400000}]},
            "by": {"$ref": "event#/properties/user"},
        },
        "patternProperties": {"^x-": {"type": "boolean"}}, "additionalProperties": {"type": ["string", "null"]},
    },
}

_FOUND = [  # table, kind, id, condition, path, rule
    ("events", "event", "event_id", "event_type not in ('click', 'view', 'purchase')", "'type'", "'enum'"), ("events", "event", "event_id", "value >= 90", "'value'", "'exclusiveMaximum'"), ("events", "event", "event_id", "event_id % 7 <> 0 and user_id > 99", "'user'", "'pattern'"),
    ("events", "event", "event_id", "event_id % 7 <> 0 and user_id > 99", "'user'", "'maxLength'"), ("events", "event", "event_id", "event_id % 7 = 0", "'<root>'", "'required:user'"), ("events", "event", "event_id", "event_id % 7 = 0 and event_id % 10 not in (0, 1)", "'<root>'", "'minProperties'"),
    ("events", "event", "event_id", "event_id % 5 <> 0 and (props->>'k')::int > 60", "'props/k'", "'maximum'"), ("events", "event", "event_id", "event_id % 10 = 1", "'<root>'", "'additionalProperties:odd'"), ("events", "event", "event_id", "event_id % 10 = 1 and event_id % 3 = 0", "'spare'", "'not'"),
    ("orders", "order", "o_orderkey", "o_orderkey % 11 = 0", "'<root>'", "'json'"), ("orders", "order", "o_orderkey", "ok and o_orderstatus = 'F' and not closed", "'<root>'", "'required:closed'"), ("orders", "order", "o_orderkey", "ok and o_orderstatus <> 'F' and closed", "'<root>'", "'not'"),
    ("orders", "order", "o_orderkey", "ok and o_custkey % 500 = o_orderkey % 1000", "'lines'", "'uniqueItems'"), ("orders", "order", "o_orderkey", "ok and o_orderkey % 1000 > 500", "'lines/1'", "'oneOf'"), ("orders", "order", "o_orderkey", "ok and length(o_orderpriority) < 6", "'lines/2'", "'oneOf'"),
    ("orders", "order", "o_orderkey", "ok and (o_totalprice < 1000 or o_totalprice > 400000)", "'price'", "'anyOf'"), ("orders", "order", "o_orderkey", "ok and o_custkey > 99", "'by'", "'pattern'"), ("orders", "order", "o_orderkey", "ok and o_custkey > 99", "'by'", "'maxLength'"), ("orders", "order", "o_orderkey", "ok and o_orderkey % 13 = 0", "'x-late'", "'type'"), ("orders", "order", "o_orderkey", "ok and o_orderkey % 17 = 0", "'note'", "'type'"),
]


@query("schema_findings", "with o as (select *, o_orderkey % 11 <> 0 ok, o_totalprice > 100000 closed from orders) " + " union all ".join(f"select '{kind}' kind, {key} id, {path} path, {rule} rule from {'o' if t == 'orders' else t} where {when}" for t, kind, key, when, path, rule in _FOUND))
def schema_findings(spark, d):
    """Members come from the columns; some are left out, added or of another type by what the columns hold."""
    k = F.col("event_id")
    props = F.when(k % 5 != 0, F.parse_json("props"))
    e = spread(table(spark, d, "events")).select(
        F.lit("event").alias("kind"), k.alias("id"),
        F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"id":'), k.cast("string")), F.concat(F.lit('"type":"'), F.col("event_type"), F.lit('"')), F.concat(F.lit('"value":'), F.col("value").cast("string")), F.when(k % 7 != 0, F.concat(F.lit('"user":"u-'), F.col("user_id").cast("string"), F.lit('"'))),
            F.concat(F.lit('"props":'), F.coalesce(F.to_json(props), F.lit("null"))), F.when(k % 10 == 1, F.lit('"odd":1')), F.when(k % 10 < 2, F.when(k % 10 == 0, F.lit('"spare":[]')).when(k % 3 == 0, F.lit('"spare":"s"')))), F.lit("}")).alias("json"),
    )
    o = F.col("o_orderkey")
    lines = F.concat(F.lit('"lines":['), F.concat_ws(",", (F.col("o_custkey") % 500).cast("string"), (o % 1000).cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))), F.lit("]"))
    r = spread(table(spark, d, "orders")).select(
        F.lit("order").alias("kind"), o.alias("id"),
        F.concat(F.when(o % 11 != 0, "{").otherwise("{{"), F.concat_ws(",", F.concat(F.lit('"status":"'), F.col("o_orderstatus"), F.lit('"')), lines, F.concat(F.lit('"price":'), F.when(o % 19 != -1, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))), F.concat(F.lit('"by":"u-'), F.col("o_custkey").cast("string"), F.lit('"')),
            F.when(F.col("o_totalprice") > 100000, F.lit('"closed":"yes"')), F.when(o % 13 == 0, F.lit('"x-late":"no"')).otherwise(F.lit('"x-late":false')), F.when(o % 17 == 0, F.lit('"note":7')).otherwise(F.lit('"note":null'))), F.lit("}")).alias("json"),
    )
    return S.validate(e.unionByName(r), "json", SCHEMAS, "kind")
