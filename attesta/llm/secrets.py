"""Secret scans: candidates by pattern, false positives removed by a random forest. Native: SQL functions only.

A candidate is a private-key block, a dotted token, the password of a URL, the value given to a key word, of any
length, or a run of 16 or more letters, digits and `_ + / -` that holds a digit; NAME= ends before it. The forest
weighs its length, character transitions, coverage by dictionary words, likeness to a path, and the words before
and after. All of it is computed inside the document's row: the text is split at its candidates, which gives
their contexts and offsets, and put together again with the secrets masked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.secret_forest import AFTER, BEFORE, CANDIDATE, MARKS, TRIGGER, as_sql, features_sql, fit_forest
from attesta.store import table

MASK = "[SECRET]"
_OWN = ("_cands", "_parts", "_feats", "_votes", "_lens", "_runs", "_heaps")
#: Lengths are summed in runs of so many, and runs in heaps of so many, so that offsets take no pass over all before them.
RUN = 32


def scan(docs: DataFrame, forest: list, least: float = 0.5) -> DataFrame:
    """docs (text, ...) -> its columns and n_candidates, secrets, masked; columns of these names are replaced.

    secrets: array of (start, length, score), offsets in characters from 0, in order. masked: the text with each
    secret replaced by [SECRET]; without one, the text itself. Null texts have no candidates and stay null, empty
    ones stay empty; very long texts are scanned whole; equal texts, repeated rows among them, give equal
    results; an empty table gives an empty one.
    """
    pattern = F.lit(CANDIDATE)
    maybe = F.col("text").rlike(TRIGGER)
    for mark in MARKS:
        maybe = maybe | F.contains("text", F.lit(mark))
    found = docs.drop("n_candidates", "secrets", "masked", *_OWN).withColumn("_cands", F.coalesce(F.when(maybe, F.regexp_extract_all("text", pattern, F.lit(0))), F.array().cast("array<string>")))
    found = found.withColumn("_parts", F.when(F.size("_cands") > 0, F.split("text", CANDIDATE, -1)))
    context = f"named_struct('b', right(_parts[i], {BEFORE}), 'c', _cands[i], 'a', left(_parts[i + 1], {AFTER}))"
    features = ", ".join(f"'{name}', {sql}" for name, sql in features_sql("x.").items())
    each = "sequence(0, size(_cands) - 1)"
    found = found.withColumn("_feats", F.expr(f"if(size(_cands) > 0, transform(transform({each}, i -> {context}), x -> named_struct({features})), null)"))
    found = found.withColumn("_votes", F.expr(f"transform(_feats, f -> {as_sql(forest)})"))
    found = found.withColumn("_lens", F.expr(f"if(size(_cands) > 0, transform({each}, i -> cast(length(_parts[i]) + length(_cands[i]) as bigint)), null)"))
    added = lambda of, at, n: f"aggregate(slice({of}, {at} + 1, {n}), 0L, (t, x) -> t + x)"
    for of, sums in (("_lens", "_runs"), ("_runs", "_heaps")):
        found = found.withColumn(sums, F.expr(f"if(size({of}) > 0, transform(sequence(0, (size({of}) - 1) div {RUN}), j -> {added(of, f'cast(j as int) * {RUN}', RUN)}), null)"))
    # a secret's start: the heaps, runs and pieces before it, and the piece it follows
    start = f"{added('_heaps', '0', f'cast(i div {RUN * RUN} as int)')} + {added('_runs', f'cast(i div {RUN * RUN} as int) * {RUN}', f'cast(i div {RUN} as int) % {RUN}')} + {added('_lens', f'cast(i div {RUN} as int) * {RUN}', f'i % {RUN}')} + length(_parts[i])"
    secrets = f"transform(filter({each}, i -> _votes[i] >= {least}), i -> named_struct('start', {start}, 'length', length(_cands[i]), 'score', _votes[i]))"
    masked = f"concat(array_join(transform({each}, i -> concat(_parts[i], if(_votes[i] >= {least}, '{MASK}', _cands[i]))), ''), _parts[size(_cands)])"
    found = found.withColumn("n_candidates", F.size("_cands").cast("long")).withColumn("secrets", F.expr(f"if(size(_cands) > 0, {secrets}, cast(array() as array<struct<start: bigint, length: int, score: double>>))"))
    return found.withColumn("masked", F.expr(f"if(size(secrets) > 0, {masked}, text)")).drop(*_OWN)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every whole document and the checksum of its masked text; awkward rows as in scan."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), fit_forest(spark))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"), F.crc32(F.col("masked").cast("binary")).alias("masked_crc32"))
