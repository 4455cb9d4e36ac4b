"""Reported statistics computed anew: effect sizes, intervals, rounding rules, partitions, storage bounds.

All functions take and give columns. Verdicts are three-valued: true, false, or null where nothing can be said.
Rounding rules are half-open: a value v printed with k decimals stands for [v - ulp/2, v + ulp/2).
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"


def cohens_d(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """Struct of pooled sd, d and g = d (1 - 3 / (4 df - 1)); null for groups under 2 or no spread."""
    df = n1 + n2 - 2
    sd = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / df)
    d = F.when((n1 >= 2) & (n2 >= 2) & (sd > 0), (m1 - m2) / sd)
    return F.struct(sd.alias("sd"), d.alias("d"), (d * (1 - 3.0 / (4 * df - 1))).alias("g"))


def odds_and_risk(a: Column, b: Column, c: Column, d: Column, level: float = 0.95) -> Column:
    """Odds and risk ratio of a 2 x 2 table with log-Wald limits; half is added to all cells if one is zero."""
    half = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    a, b, c, d = a + half, b + half, c + half, d + half
    z = NormalDist().inv_cdf(0.5 + level / 2)
    log_or, se_or = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    log_rr, se_rr = F.log((a / (a + b)) / (c / (c + d))), F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    return F.struct(F.exp(log_or).alias("odds_ratio"), F.exp(log_or - z * se_or).alias("or_low"), F.exp(log_or + z * se_or).alias("or_high"), F.exp(log_rr).alias("risk_ratio"), F.exp(log_rr - z * se_rr).alias("rr_low"), F.exp(log_rr + z * se_rr).alias("rr_high"))


def ci_consistency(est: Column, low: Column, high: Column, level: float = 0.95, log_scale: bool = False, tolerance: float = 0.02, symmetric: Column | None = None) -> Column:
    """Whether an estimate lies at the middle of its interval (geometric on a log scale), and the implied error."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    middle = F.sqrt(low * high) if log_scale else (low + high) / 2
    width = F.log(high / low) if log_scale else high - low
    off = F.abs(est - middle) / F.greatest(F.abs(middle), F.abs(width) * 1e-9, F.lit(1e-12))
    ok = (off <= tolerance) & (est >= low) & (est <= high)
    return F.struct(F.when(symmetric if symmetric is not None else F.lit(True), ok).alias("consistent"), middle.alias("middle"), (width / (2 * z)).alias("implied_se"))


def p_matches(printed: Column, recomputed: Column) -> Column:
    """Whether a p value rounds to the printed literal: trailing zeros count as decimals."""
    places = F.length(F.coalesce(F.nullif(F.regexp_extract(printed, r"\.(\d+)$", 1), F.lit("")), F.lit("")))
    half = F.pow(F.lit(10.0), -places).cast(DECIMAL) / 2
    p, r = printed.try_cast(DECIMAL), recomputed.cast(DECIMAL)
    return F.when((places <= 17) & p.isNotNull(), (r >= p - half) & (r < p + half))


def percentage_matches(count: Column, printed: Column, whole: Column, places: int = 1) -> Column:
    """Whether count / whole rounds to the printed percentage, by cross-multiplication; null without a whole."""
    half = 0.5 * 10.0**-places
    n, p = count.cast(DECIMAL), printed.cast(DECIMAL)
    return F.when(whole > 0, (n * 100 >= (p - F.lit(half).cast(DECIMAL)) * whole) & (n * 100 < (p + F.lit(half).cast(DECIMAL)) * whole))


def sd_possible(sd: Column, low: Column, high: Column, n: Column) -> Column:
    """Whether a standard deviation fits a scale: at most half its range times sqrt(n / (n - 1))."""
    return F.when(n >= 2, sd <= (high - low) / 2 * F.sqrt(n / (n - 1)) + 1e-12)


def sample_size_from_df(df: Column, n: Column, kind: Column, params: Column) -> Column:
    """Whether n goes with the degrees of freedom of a one-sample, two-sample or regression test."""
    plus = F.when(kind == "one_sample", 1).when(kind == "two_sample", 2).when(kind == "regression", params)
    return F.when(df == F.floor(df), df + plus == n)


def values_agree(a: Column, b: Column, relative: float = 1e-6, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b))) + 1e-15


def partition_conserved(parts: Column, whole: Column, tolerance: float = 0.0) -> Column:
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.struct(total.alias("total"), (F.abs(total - whole) <= tolerance + 1e-9).alias("consistent"))


def shares_conserved(parts: Column, shares: Column, whole: Column) -> Column:
    """Unit of printed shares (fraction or percent, whichever errs less) and the largest error in it."""
    pairs = F.arrays_zip(parts.alias("n"), shares.alias("s"))
    sum_of = lambda unit: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.abs(x["n"] / whole * unit - x["s"]))
    one, hundred = sum_of(1.0), sum_of(100.0)
    return F.struct(F.when(one <= hundred, "fraction").otherwise("percent").alias("unit"), F.least(one, hundred).alias("error"))


def constant_offsets(cells: DataFrame, baseline: str, min_rows: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """cells (matrix_id, row, col, val): columns whose difference to the baseline column is (nearly) constant."""
    base = cells.where(F.col("col") == baseline).select("matrix_id", "row", F.col("val").alias("base"))
    delta = cells.where(F.col("col") != baseline).join(base, ["matrix_id", "row"]).withColumn("delta", F.col("val") - F.col("base"))
    by = delta.groupBy("matrix_id", "col").agg(F.count("*").alias("rows"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.coalesce(F.var_samp("delta"), F.lit(0.0)), 6).alias("variance"), (F.max("delta") - F.min("delta")).alias("span"))
    return by.where(F.col("rows") >= min_rows).withColumn("suspicious", F.col("span") <= tolerance).drop("span")


def storage_bound(items: Column, dim: Column, bytes_each: Column, printed_mb: Column, overhead: float = 0.1) -> Column:
    """Whether a printed size in MB or MiB can hold items * dim values: either unit, half a printed unit of slack,
    and up to a share of overhead."""
    raw = (items * dim * bytes_each).cast("double")
    fits = lambda unit: (printed_mb + 0.5 >= raw / unit) & (printed_mb - 0.5 <= raw * (1 + overhead) / unit)
    return F.struct(raw.alias("raw_bytes"), F.when(fits(1e6), "MB").when(fits(1048576.0), "MiB").alias("unit"), (fits(1e6) | fits(1048576.0)).alias("consistent"))


def p_relation(printed: Column, relation: Column, recomputed: Column) -> Column:
    """A printed p with its relation: equal means rounding, below and above are compared as they stand."""
    value = printed.try_cast("double")
    return F.when(relation == "=", p_matches(printed, recomputed)).when(relation == "<", recomputed < value).when(relation == "<=", recomputed <= value).when(relation == ">", recomputed > value).when(relation == ">=", recomputed >= value)


def rounding_interval(literal: Column) -> Column:
    """Interval of values that print as this literal; closed at the end nearer zero, so mirrored for negatives."""
    places = F.length(F.coalesce(F.nullif(F.regexp_extract(literal, r"\.(\d+)$", 1), F.lit("")), F.lit("")))
    v, half = literal.try_cast("double"), F.pow(F.lit(10.0), -places) / 2
    return F.struct((v - half).alias("lower"), (v + half).alias("upper"), (v >= 0).alias("lower_closed"), (v < 0).alias("upper_closed"))


def running_agreement(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each value with the sums of all others in its group, from the frames before and after it."""
    w = Window.partitionBy(by).orderBy(order)
    before, after = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.sum(value).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("others", F.round(F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0)), 6))
