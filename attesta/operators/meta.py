"""Meta-analysis over studies (analysis, study_id, yi, vi[, subgroup, moderator]); variances must be positive.

Sums are taken over effects centred on the analysis' least effect, so that large common offsets cancel exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.special import p_from_chi2, p_from_t, p_from_z

Z95 = 1.959963984540054


def effect_conversions(d: Column, n1: Column, n2: Column, p0: Column) -> list[Column]:
    """d to its variance, g, log odds ratio, r, odds ratio and risk ratio at base rate p0."""
    df = n1 + n2 - 2
    j = 1 - 3.0 / (4 * df - 1)
    var_d = (n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2))
    log_or = d * math.pi / math.sqrt(3)
    a = (n1 + n2) * (n1 + n2) / (n1 * n2)
    odds = F.exp(log_or)
    return [var_d.alias("var_d"), (d * j).alias("g"), (var_d * j * j).alias("var_g"), log_or.alias("log_or"), (var_d * math.pi**2 / 3).alias("var_log_or"), (d / F.sqrt(d * d + a)).alias("r"), odds.alias("odds_ratio"), (odds / (1 - p0 + p0 * odds)).alias("risk_ratio")]


def heterogeneity(studies: DataFrame, by: list[str]) -> DataFrame:
    """k, Q, df, I2 (0 to 1), DerSimonian-Laird tau2 and C, and the fixed-effect estimate, by analysis."""
    low = studies.where("vi > 0 and yi is not null").withColumn("y0", F.min("yi").over(Window.partitionBy(*by)))
    w, y = 1 / F.col("vi"), F.col("yi") - F.col("y0")
    s = low.groupBy(*by).agg(F.count("*").alias("k"), F.max("y0").alias("y0"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"))
    q, c = F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")), F.col("sw") - F.col("sww") / F.col("sw")
    s = s.withColumn("q", q).withColumn("df", F.col("k") - 1).withColumn("c", c)
    return s.withColumn("i2", F.when((F.col("df") > 0) & (F.col("q") > 0), F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0)).withColumn("tau2", F.when((F.col("df") > 0) & (F.col("c") > 0), F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("c"))).otherwise(0.0)).withColumn("fixed", F.col("y0") + F.col("swy") / F.col("sw"))


def pool(studies: DataFrame, by: list[str], random: bool = False) -> DataFrame:
    """Estimate, standard error and 95 % interval by analysis."""
    het = heterogeneity(studies, by).select(*by, "tau2", "y0")
    tau = F.col("tau2") if random else F.lit(0.0)
    rows = studies.where("vi > 0 and yi is not null").join(het, by).withColumn("w", 1 / (F.col("vi") + tau))
    s = rows.groupBy(*by).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), (F.max("y0") + F.sum(F.col("w") * (F.col("yi") - F.col("y0"))) / F.sum("w")).alias("estimate"), F.max(tau).alias("tau2"))
    se = 1 / F.sqrt("sw")
    return s.select(*by, "k", "estimate", se.alias("se"), (F.col("estimate") - Z95 * se).alias("ci_low"), (F.col("estimate") + Z95 * se).alias("ci_high"), "tau2")


def weights(studies: DataFrame, by: list[str], random: bool = False) -> DataFrame:
    """Share of the weight of each study."""
    tau = heterogeneity(studies, by).select(*by, (F.col("tau2") if random else F.lit(0.0)).alias("tau2"))
    rows = studies.where("vi > 0").join(tau, by).withColumn("w", 1 / (F.col("vi") + F.col("tau2")))
    return rows.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(*by)))


def leave_one_out(studies: DataFrame, by: list[str], random: bool = True) -> DataFrame:
    """The pooled result without each study, between-study variance fitted anew."""
    own = studies.select(*by, F.col("study_id").alias("left_out"))
    rest = own.join(studies, by).where("study_id <> left_out")  # k rows a study, inside one analysis
    return pool(rest, [*by, "left_out"], random)


def subgroups(studies: DataFrame, by: list[str]) -> DataFrame:
    """Q within and between subgroups (fixed effect), with the p value of the latter."""
    total = heterogeneity(studies, by).select(*by, F.col("q").alias("q_total"))
    inner = heterogeneity(studies, [*by, "subgroup"]).groupBy(*by).agg(F.sum("q").alias("q_within"), (F.count("*") - 1).alias("df_between"))
    out = total.join(inner, by).withColumn("q_between", F.greatest(F.lit(0.0), F.col("q_total") - F.col("q_within")))
    return out.withColumn("p_between", F.when(F.col("df_between") > 0, p_from_chi2("q_between", F.col("df_between").cast("double"))))


def egger(studies: DataFrame, by: list[str]) -> DataFrame:
    """Regression of y / se on 1 / se: intercept, its t and p (null under three studies)."""
    se = F.sqrt("vi")
    x = studies.where("vi > 0").select(*by, (F.col("yi") / se).alias("y"), (1 / se).alias("x"))
    s = x.groupBy(*by).agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"))
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    t = F.col("intercept") / F.sqrt(rss / (F.col("k") - 2) * (1 / F.col("k") + F.col("mx") * F.col("mx") / F.col("sxx")))
    s = s.withColumn("t", F.when(F.col("k") >= 3, t))
    return s.withColumn("p", F.when(F.col("t").isNotNull(), p_from_t("t", (F.col("k") - 2).cast("double")))).select(*by, "k", "slope", "intercept", "t", "p")


def _wls(rows: DataFrame, by: list[str], w: Column) -> DataFrame:
    x, y = F.col("moderator"), F.col("yi")
    s = rows.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(w * y).alias("t0"), F.sum(w * x * y).alias("t1"), F.sum(w * y * y).alias("u"), F.sum(w * w).alias("v0"), F.sum(w * w * x).alias("v1"), F.sum(w * w * x * x).alias("v2"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    s = s.withColumn("det", det).withColumn("b1", (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / F.col("det"))
    return s.withColumn("b0", (F.col("t0") - F.col("b1") * F.col("s1")) / F.col("s0"))


def meta_regression(studies: DataFrame, by: list[str], random: bool = True) -> DataFrame:
    """Weighted regression on one moderator; the residual variance is the method of moments' by the trace of P."""
    rows = studies.where("vi > 0 and moderator is not null")
    first = _wls(rows, by, 1 / F.col("vi"))
    q = F.col("u") - F.col("b0") * F.col("t0") - F.col("b1") * F.col("t1")
    trace = F.col("s0") - (F.col("s2") * F.col("v0") - 2 * F.col("s1") * F.col("v1") + F.col("s0") * F.col("v2")) / F.col("det")
    tau = first.select(*by, (F.when(F.col("k") > 2, F.greatest(F.lit(0.0), (q - (F.col("k") - 2)) / trace)).otherwise(0.0) if random else F.lit(0.0)).alias("tau2"))
    second = _wls(rows.join(tau, by), by, 1 / (F.col("vi") + F.col("tau2"))).join(tau, by)
    second = second.withColumn("se1", F.sqrt(F.col("s0") / F.col("det"))).withColumn("z", F.col("b1") / F.col("se1"))
    return second.withColumn("p", p_from_z("z")).select(*by, "k", F.col("b0").alias("intercept"), F.col("b1").alias("slope"), F.col("se1").alias("se"), "z", "p", "tau2")


def trim_and_fill(studies: DataFrame, by: list[str], side: str = "left", rounds: int = 100) -> DataFrame:
    """Studies missing from one side of the funnel by the L0 estimator, and the estimate with them filled in.

    Iterated inside each analysis; null without convergence or under three studies.
    """
    sign = 1.0 if side == "left" else -1.0
    kinds = dict(studies.dtypes)

    def fixed(y: np.ndarray, v: np.ndarray) -> float:
        return float((y / v).sum() / (1 / v).sum())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.vi > 0]
        y, v = sign * pdf.yi.to_numpy(), pdf.vi.to_numpy()
        order = np.lexsort((v, y))
        y, v, n = y[order], v[order], len(y)
        missing, k0 = None, 0
        if n >= 3:
            for _ in range(rounds):
                keep = n - k0
                centred = y - fixed(y[:keep], v[:keep])
                size = np.abs(centred)
                rank = pd.Series(size).rank(method="average").to_numpy()
                after = max(0, min(n - 2, int(np.rint((4 * rank[centred > 0].sum() - n * (n + 1)) / (2 * n - 1)))))
                if after == k0:
                    missing = k0
                    break
                k0 = after
        filled = math.nan
        if missing is not None:
            centre = fixed(y[: n - missing], v[: n - missing])
            extra = 2 * centre - y[n - missing :]
            filled = sign * fixed(np.r_[y, extra], np.r_[v, v[n - missing :]])
        keys = {c: [pdf[c].iloc[0] if len(pdf) else None] for c in by}
        return pd.DataFrame(keys | {"k": [n], "missing": pd.array([missing], dtype="Int64"), "estimate": [filled]})

    return studies.groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", k long, missing long, estimate double")
