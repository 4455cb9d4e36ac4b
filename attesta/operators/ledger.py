"""Exports and imports of evidence state, and pooling in exact arithmetic."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.special import p_from_chi2, p_from_f, p_from_t, p_from_z
from attesta.operators.recompute import p_relation


def evidence_id(claim: Column, artifact: Column, locator: Column) -> Column:
    return F.concat(F.lit("ev-"), F.left(F.sha2(F.concat_ws("\x1f", claim.cast("string"), artifact.cast("string"), locator.cast("string")), 256), F.lit(16)))


def export_graph(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (claim, status), evidence (claim, artifact, locator, stance) -> a row a claim with its evidence by stance."""
    e = evidence.withColumn("id", evidence_id(F.col("claim"), F.col("artifact"), F.col("locator")))
    ids = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("stance") == s, F.col("id")))), ",")
    by = e.groupBy("claim").agg(ids("supports").alias("supported_by"), ids("contradicts").alias("contradicted_by"), F.count_if(~F.col("stance").isin("supports", "contradicts")).alias("uncertain"))
    return claims.join(by, "claim", "left").select("claim", "status", F.coalesce("supported_by", F.lit("")).alias("supported_by"), F.coalesce("contradicted_by", F.lit("")).alias("contradicted_by"), F.coalesce("uncertain", F.lit(0)).cast("long").alias("uncertain"))


def export_ledger(events: DataFrame, corrections: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """A row a decision: first and last state, number of events and of changes, verdict after corrections."""
    w = Window.partitionBy(key).orderBy(order)
    e = events.withColumn("_from", F.lag(state).over(w))
    s = e.groupBy(key).agg(F.min_by(state, order).alias("first_state"), F.max_by(state, order).alias("last_state"), F.count("*").alias("events"), F.count_if(F.col("_from") != F.col(state)).alias("changes"))
    c = corrections.groupBy(key).agg(F.max_by("verdict", "seq").alias("verdict"))
    return s.join(c, key, "left").withColumn("verdict", F.coalesce("verdict", "last_state"))


def legacy_watch(payloads: DataFrame) -> DataFrame:
    """payloads (watcher, json), the JSON a map of DOI to retracted flag -> observations; a payload whose entries
    contradict each other after normalisation is refused as a whole."""
    m = payloads.select("watcher", F.explode(F.from_json("json", "map<string, boolean>")).alias("k", "flag")).select("watcher", T.normal_doi(F.col("k")).alias("item_key"), "flag").where("item_key is not null")
    s = m.groupBy("watcher", "item_key").agg(F.bool_or("flag").alias("any"), F.bool_and("flag").alias("all"))
    bad = s.where("any <> all").select("watcher").distinct()
    return s.join(bad, "watcher", "left_anti").select("watcher", "item_key", F.when(F.col("any"), "retracted").otherwise("not_retracted").alias("status"))


def pool_exact(studies: DataFrame, by: list[str]) -> DataFrame:
    """The fixed-effect estimate and Q of each analysis in rational arithmetic, for variances too far apart for doubles."""
    kinds = dict(studies.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(Fraction(y), Fraction(v)) for y, v in zip(pdf.yi.tolist(), pdf.vi.tolist(), strict=True) if v > 0 and y == y]
        w = sum((1 / v for _, v in rows), Fraction(0))
        est = sum((y / v for y, v in rows), Fraction(0)) / w if w else None
        q = sum(((y - est) ** 2 / v for y, v in rows), Fraction(0)) if w else None
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in by} | {"k": [len(rows)], "estimate": [float(est) if w else None], "q": [float(q) if w else None]})

    return studies.where("yi is not null and vi is not null").groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", k long, estimate double, q double")


def check_results(rows: DataFrame) -> DataFrame:
    """rows (id, kind t/f/chi2/z, stat, df1, df2, relation, printed): the p value recomputed and whether it agrees.

    What cannot be computed has no verdict and says why.
    """
    k = F.col("kind")
    p = F.when(k == "t", p_from_t("stat", "df1")).when(k == "f", p_from_f("stat", "df1", "df2")).when(k == "chi2", p_from_chi2("stat", "df1")).when(k == "z", p_from_z("stat"))
    r = rows.withColumn("p", p).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    return r.select("id", "kind", "p", F.when(F.col("p").isNotNull(), p_relation(F.col("printed"), F.col("relation"), F.col("p"))).alias("consistent"), F.when(~k.isin("t", "f", "chi2", "z"), "unsupported kind").when(F.col("p").isNull(), "not computable").alias("error"))
