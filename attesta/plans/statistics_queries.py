"""Recomputed statistics and meta-analysis over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import special
from attesta.operators import meta as M
from attesta.operators import recompute as R
from attesta.plans.registry import query
from attesta.store import table

Z = 1.959963984540054


def r6(c):
    return F.round(c, 6)


# effects and intervals


def _groups(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[f(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))).alias(f"{n}{i}") for i, s in ((1, "F"), (2, "O")) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    return li.where("n1 >= 2 and n2 >= 2")


_GROUPS = "g as (select l_returnflag, avg(l_quantity) filter (l_linestatus = 'F') m1, stddev_samp(l_quantity) filter (l_linestatus = 'F') s1, count(*) filter (l_linestatus = 'F') n1, avg(l_quantity) filter (l_linestatus = 'O') m2, stddev_samp(l_quantity) filter (l_linestatus = 'O') s2, count(*) filter (l_linestatus = 'O') n2 from lineitem group by 1 having n1 >= 2 and n2 >= 2), e as (select *, sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) sd from g)"


@query("effect_size", f"with {_GROUPS} select l_returnflag, round(sd, 6) sd, round((m1 - m2) / sd, 6) d, round((m1 - m2) / sd * (1 - 3.0 / (4 * (n1 + n2 - 2) - 1)), 6) g from e")
def effect_size(spark, d):
    e = R.cohens_d(*[F.col(x) for x in ("m1", "s1", "n1", "m2", "s2", "n2")])
    return _groups(spark, d).withColumn("e", e).select("l_returnflag", r6("e.sd").alias("sd"), r6("e.d").alias("d"), r6("e.g").alias("g"))


@query("effect_conversions", f"with {_GROUPS}, x as (select *, (m1 - m2) / sd d, (n1 + n2)::double / (n1::double * n2) + ((m1 - m2) / sd) ** 2 / (2 * (n1 + n2)) var_d, 1 - 3.0 / (4 * (n1 + n2 - 2) - 1) j from e) select l_returnflag, round(var_d, 6) var_d, round(d * j, 6) g, round(var_d * j * j, 6) var_g, round(d * pi() / sqrt(3), 6) log_or, round(var_d * pi() ** 2 / 3, 6) var_log_or, round(d / sqrt(d * d + (n1 + n2) ** 2 / (n1::double * n2)), 6) r, round(exp(d * pi() / sqrt(3)), 6) odds_ratio, round(exp(d * pi() / sqrt(3)) / (0.8 + 0.2 * exp(d * pi() / sqrt(3))), 6) risk_ratio from x")
def effect_conversions(spark, d):
    g = _groups(spark, d).withColumn("e", R.cohens_d(*[F.col(x) for x in ("m1", "s1", "n1", "m2", "s2", "n2")]))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    out = g.select("l_returnflag", *M.effect_conversions(F.col("e.d"), n1, n2, F.lit(0.2)))
    return out.select("l_returnflag", *[r6(c).alias(c) for c in out.columns[1:]])


_CELLS = "c as (select o_orderpriority k, count(*) filter (o_orderstatus = 'F' and o_totalprice > 150000)::double a, count(*) filter (o_orderstatus = 'F' and o_totalprice <= 150000)::double b, count(*) filter (o_orderstatus <> 'F' and o_totalprice > 150000)::double c, count(*) filter (o_orderstatus <> 'F' and o_totalprice <= 150000)::double d from orders group by 1), h as (select k, a + h a, b + h b, c + h c, d + h d from (select *, case when a * b * c * d = 0 then 0.5 else 0 end h from c))"


@query("odds_ratio", f"with {_CELLS}, s as (select *, ln(a * d / (b * c)) lo, sqrt(1 / a + 1 / b + 1 / c + 1 / d) se, ln((a / (a + b)) / (c / (c + d))) lr, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) sr from h) select k area, round(exp(lo), 6) odds_ratio, round(exp(lo - {Z} * se), 6) or_low, round(exp(lo + {Z} * se), 6) or_high, round(exp(lr), 6) risk_ratio, round(exp(lr - {Z} * sr), 6) rr_low, round(exp(lr + {Z} * sr), 6) rr_high from s")
def odds_ratio(spark, d):
    f, p = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("area")).agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("a", f & p), ("b", f & ~p), ("c", ~f & p), ("d", ~f & ~p))])
    out = c.withColumn("x", R.odds_and_risk(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).select("area", "x.*")
    return out.select("area", *[r6(x).alias(x) for x in out.columns[1:]])


@query("ci_consistency", f"with v as (select o_orderkey id, o_totalprice est, o_totalprice - 100 - o_custkey % 7 low, o_totalprice + 100 high from orders) select id, abs(est - (low + high) / 2) / greatest(abs((low + high) / 2), abs(high - low) * 1e-9, 1e-12) <= 0.00001 and est between low and high consistent, round((high - low) / (2 * {Z}), 6) implied_se from v")
def ci_consistency(spark, d):
    e = F.col("o_totalprice")
    x = R.ci_consistency(e, e - 100 - F.col("o_custkey") % 7, e + 100, tolerance=0.00001)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x")).select("id", "x.consistent", r6("x.implied_se").alias("implied_se"))


# rounding rules


@query("p_match", "with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount p, case when l_linenumber % 2 = 0 then '0.05' else '0.050' end lit from lineitem) select lit, count(*) n, count(*) filter (p::decimal(38,18) >= 0.05 - h and p::decimal(38,18) < 0.05 + h) consistent from (select *, case when lit = '0.05' then 0.005::decimal(38,18) else 0.0005::decimal(38,18) end h from v) group by lit")
def p_match(spark, d):
    lit = F.when(F.col("l_linenumber") % 2 == 0, "0.05").otherwise("0.050")
    return table(spark, d, "lineitem").select(lit.alias("lit"), R.p_matches(lit, F.col("l_discount")).alias("ok")).groupBy("lit").agg(F.count("*").alias("n"), F.count_if("ok").alias("consistent"))


@query("p_relation", "with v as (select l_discount p, ['=', '<', '<=', '>', '>='][(l_linenumber % 5 + 1)::int] rel from lineitem) select rel, count(*) n, count(*) filter (case rel when '=' then p::decimal(38,18) >= 0.045 and p::decimal(38,18) < 0.055 when '<' then p < 0.05 when '<=' then p <= 0.05 when '>' then p > 0.05 else p >= 0.05 end) consistent from v group by rel")
def p_relation(spark, d):
    rel = F.element_at(F.array(*[F.lit(x) for x in ("=", "<", "<=", ">", ">=")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    v = table(spark, d, "lineitem").select(rel.alias("rel"), F.col("l_discount").alias("p"))
    return v.groupBy("rel").agg(F.count("*").alias("n"), F.count_if(R.p_relation(F.lit("0.05"), F.col("rel"), F.col("p"))).alias("consistent"))


@query("percentage_check", "with c as (select o_orderpriority area, count(*) filter (o_orderstatus = 'F') n, count(*) w from orders group by 1), v as (select *, round(100.0 * n / w, 1)::decimal(38,18) + case when area like '1%' then 0.2 else 0 end p from c) select area, n::decimal(38,18) * 100 >= (p - 0.05) * w and n::decimal(38,18) * 100 < (p + 0.05) * w consistent from v")
def percentage_check(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("area")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count("*").alias("w"))
    printed = F.round(F.lit(100) * F.col("n") / F.col("w"), 1).cast(R.DECIMAL) + F.when(F.col("area").startswith("1"), F.lit(0.2)).otherwise(0.0).cast(R.DECIMAL)
    return c.select("area", R.percentage_matches(F.col("n"), printed, F.col("w")).alias("consistent"))


@query("sd_possible", "select p_partkey, case when p_size >= 2 then p_retailprice / 400 <= 2.0 * sqrt(p_size / (p_size - 1)::double) + 1e-12 end possible from part")
def sd_possible(spark, d):
    return table(spark, d, "part").select("p_partkey", R.sd_possible(F.col("p_retailprice") / 400, F.lit(1.0), F.lit(5.0), F.col("p_size")).alias("possible"))


@query("sample_size_df", "with v as (select p_partkey, p_size n, ['one_sample', 'two_sample', 'regression', 'welch'][(p_partkey % 4 + 1)::int] kind, (p_size - 1 - p_partkey % 3)::double + case when p_partkey % 11 = 0 then 0.5 else 0 end df from part) select p_partkey, case when df = floor(df) then df + case kind when 'one_sample' then 1 when 'two_sample' then 2 when 'regression' then 3 end = n end consistent from v")
def sample_size_df(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("one_sample", "two_sample", "regression", "welch")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    df = (F.col("p_size") - 1 - F.col("p_partkey") % 3).cast("double") + F.when(F.col("p_partkey") % 11 == 0, 0.5).otherwise(0.0)
    return table(spark, d, "part").select("p_partkey", R.sample_size_from_df(df, F.col("p_size"), kind, F.lit(3)).alias("consistent"))


@query("values_agree", "select p_partkey, abs(p_retailprice - round(p_retailprice, 0)) <= greatest(0.0, 1e-4 * greatest(abs(p_retailprice), abs(round(p_retailprice, 0)))) + 1e-15 agree from part")
def values_agree(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", R.values_agree(p, F.round(p, 0), relative=1e-4).alias("agree"))


@query("partition_sums", "with c as (select o_orderpriority area, count(*) filter (o_orderstatus = 'F')::double f, count(*) filter (o_orderstatus = 'O')::double o, count(*)::double w from orders group by 1) select area, f + o total, abs(f + o - w) <= 1e-9 consistent, 'percent' unit, round(abs(100 * f / w - round(100 * f / w, 1)) + abs(100 * o / w - round(100 * o / w, 1)), 6) error from c")
def partition_sums(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("area")).agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("f"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("o"), F.count("*").cast("double").alias("w"))
    parts, shares = F.array("f", "o"), F.array(*[F.round(F.lit(100) * F.col(x) / F.col("w"), 1) for x in "fo"])
    c = c.withColumn("parts", parts).withColumn("shares", shares)
    return c.withColumn("x", R.partition_conserved(F.col("parts"), F.col("w"))).withColumn("y", R.shares_conserved(F.col("parts"), F.col("shares"), F.col("w"))).select("area", "x.total", "x.consistent", "y.unit", r6("y.error").alias("error"))


@query("ablation_offsets", "with c as (select l_returnflag m, l_linenumber r, sum(l_quantity) a, sum(l_quantity) + 3.0 b, sum(l_tax) t from lineitem group by 1, 2), x as (select m, r, 'b' col, b - a dl from c union all select m, r, 't', t - a from c) select m matrix_id, col, count(*) rows, round(avg(dl), 6) mean_delta, round(coalesce(var_samp(dl), 0), 6) variance, max(dl) - min(dl) <= 1e-6 suspicious from x group by 1, 2 having count(*) >= 3")
def ablation_offsets(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("matrix_id"), F.col("l_linenumber").alias("row")).agg(F.sum("l_quantity").alias("a"), (F.sum("l_quantity") + 3.0).alias("b"), F.sum("l_tax").alias("t"))
    return R.constant_offsets(c.unpivot(["matrix_id", "row"], ["a", "b", "t"], "col", "val"), "a", tolerance=1e-6)


@query("storage_bound", "with v as (select label, count(*) n, max(len(embedding)) dim from embeddings group by 1), w as (select *, (n * dim * 4)::double raw, round(n * dim * 4 / 1e6, 0) mb from v) select label, raw raw_bytes, case when mb + 0.5 >= raw / 1e6 and mb - 0.5 <= raw * 1.1 / 1e6 then 'MB' when mb + 0.5 >= raw / 1048576.0 and mb - 0.5 <= raw * 1.1 / 1048576.0 then 'MiB' end unit, (mb + 0.5 >= raw / 1e6 and mb - 0.5 <= raw * 1.1 / 1e6) or (mb + 0.5 >= raw / 1048576.0 and mb - 0.5 <= raw * 1.1 / 1048576.0) consistent from w")
def storage_bound(spark, d):
    v = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    return v.withColumn("x", R.storage_bound(F.col("n"), F.col("dim"), F.lit(4), F.round(F.col("n") * F.col("dim") * 4 / 1e6, 0))).select("label", "x.*")


@query("rounding_interval", "with v as (select p_partkey, p_retailprice x from part) select p_partkey, round(x - 0.005, 6) lower, round(x + 0.005, 6) upper, x >= 0 lower_closed, x < 0 upper_closed from v")
def rounding_interval(spark, d):
    x = R.rounding_interval(F.format_string("%.2f", F.col("p_retailprice")))
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", r6("x.lower").alias("lower"), r6("x.upper").alias("upper"), "x.lower_closed", "x.upper_closed")


@query("complement_sums", "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey) - o_totalprice, 4) others from orders")
def complement_sums(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.running_agreement(o, "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", F.round("others", 4).alias("others"))


# tails


_T = "with n as (select distinct l_linenumber t from lineitem), d as (select t, df, atan(t / sqrt(df)) a from n, (select unnest([1, 2, 3, 4, 5, 6]) df))"


@query("p_from_t", f"{_T} select t, df, round(case df when 1 then 1 - 2 / pi() * a when 2 then 1 - sin(a) when 3 then 1 - 2 / pi() * (a + sin(a) * cos(a)) when 4 then 1 - sin(a) * (1 + cos(a) ** 2 / 2) when 5 then 1 - 2 / pi() * (a + sin(a) * (cos(a) + 2 * cos(a) ** 3 / 3)) else 1 - sin(a) * (1 + cos(a) ** 2 / 2 + 3 * cos(a) ** 4 / 8) end, 9) p from d")
def p_from_t(spark, d):
    """Two-sided tails at one to six degrees of freedom, for which there are closed forms."""
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("t")).distinct().withColumn("df", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return n.select("t", "df", F.round(special.p_from_t(F.col("t").cast("double"), F.col("df").cast("double")), 9).alias("p"))


@query("p_from_f", f"{_T} select t f, 2 df1, df df2, round((1 + 2.0 * t / df) ** (-df / 2.0), 9) p from d union all select t * t, 1, df, round(case df when 1 then 1 - 2 / pi() * a when 2 then 1 - sin(a) when 3 then 1 - 2 / pi() * (a + sin(a) * cos(a)) when 4 then 1 - sin(a) * (1 + cos(a) ** 2 / 2) when 5 then 1 - 2 / pi() * (a + sin(a) * (cos(a) + 2 * cos(a) ** 3 / 3)) else 1 - sin(a) * (1 + cos(a) ** 2 / 2 + 3 * cos(a) ** 4 / 8) end, 9) from d")
def p_from_f(spark, d):
    """Right tails with two degrees above, by their closed form, and with one, as tails of t."""
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("t")).distinct().withColumn("df2", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("df1", F.explode(F.array(F.lit(1), F.lit(2))))
    f = F.when(F.col("df1") == 1, F.col("t") * F.col("t")).otherwise(F.col("t"))
    return n.withColumn("f", f).select("f", "df1", "df2", F.round(special.p_from_f(F.col("f").cast("double"), F.col("df1").cast("double"), F.col("df2").cast("double")), 9).alias("p"))


@query("p_from_chi2", "with n as (select distinct l_linenumber x from lineitem) select x, df, round(exp(-x / 2.0) * (1 + case when df > 2 then x / 2.0 else 0 end + case when df > 4 then (x / 2.0) ** 2 / 2 else 0 end + case when df > 6 then (x / 2.0) ** 3 / 6 else 0 end), 9) p from n, (select unnest([2, 4, 6, 8]) df)")
def p_from_chi2(spark, d):
    """Right tails at even degrees of freedom, which are sums of a Poisson distribution."""
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("x")).distinct().withColumn("df", F.explode(F.array(*[F.lit(i) for i in (2, 4, 6, 8)])))
    return n.select("x", "df", F.round(special.p_from_chi2(F.col("x").cast("double"), F.col("df").cast("double")), 9).alias("p"))


#: Weights of Simpson's rule on 2,000 steps, as SQL over i from 0 to 2000.
_SIMPSON = "(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)"


@query("p_from_z", f"with n as (select distinct l_linenumber from lineitem), g as (select l_linenumber, l_linenumber / 2.0 z, unnest(range(0, 2001)) i from n) select l_linenumber, round(1 - 2 * any_value(z) / 6000 * sum({_SIMPSON} * exp(-0.5 * (z * i / 2000) ** 2) / sqrt(2 * pi())), 9) p from g group by 1")
def p_from_z(spark, d):
    """Two-sided normal tails; the SQL integrates the density by Simpson's rule."""
    n = table(spark, d, "lineitem").select("l_linenumber").distinct()
    return n.select("l_linenumber", F.round(special.p_from_z(F.col("l_linenumber") / 2.0), 9).alias("p"))


@query("power_ttest")
def power_ttest(spark, d):
    g = _groups(spark, d).withColumn("e", R.cohens_d(*[F.col(x) for x in ("m1", "s1", "n1", "m2", "s2", "n2")]))
    return g.select("l_returnflag", special.achieved_power("e.d", F.col("n1").cast("double"), F.col("n2").cast("double"), F.lit(0.05)).alias("power"))


@query("required_n_ttest")
def required_n_ttest(spark, d):
    n = table(spark, d, "lineitem").select("l_linenumber").distinct()
    return n.select("l_linenumber", special.needed_n(F.col("l_linenumber") / 10.0, F.lit(0.8), F.lit(0.05), F.lit(1.0)).alias("n"))


# meta-analysis: event types are studies, one analysis over all of them and one for each half of users


def studies(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("analysis"), F.col("event_type").alias("study_id")).agg(F.avg("value").alias("yi"), (F.var_samp("value") / F.count("value")).alias("vi"), F.log(F.count("value").cast("double")).alias("moderator"))
    return e.withColumn("subgroup", F.when(F.col("study_id").isin("click", "view"), "light").otherwise("heavy"))


_ST = "st as (select user_id % 2 analysis, event_type study_id, avg(value) yi, var_samp(value) / count(value) vi, ln(count(value)) moderator, case when event_type in ('click', 'view') then 'light' else 'heavy' end subgroup from events group by 1, 2)"


def _het(by: str, source: str = "st") -> str:
    return f"(select {by}, count(*) k, sum(1/vi) sw, sum(1/vi/vi) sww, sum(yi/vi)/sum(1/vi) fixed, greatest(0, sum((yi - m) * (yi - m) / vi) - sum((yi - m) / vi) ** 2 / sum(1/vi)) q, sum(1/vi) - sum(1/vi/vi)/sum(1/vi) c, count(*) - 1 df from (select *, avg(yi) over (partition by {by}) m from {source}) group by {by})"


_TAU = "case when df > 0 and c > 0 then greatest(0, (q - df) / c) else 0 end"


@query("heterogeneity", f"with {_ST} select analysis, k, round(q, 6) q, df, round(case when df > 0 and q > 0 then greatest(0, (q - df) / q) else 0 end, 6) i2, round({_TAU}, 6) tau2, round(fixed, 6) fixed from {_het('analysis')}")
def heterogeneity(spark, d):
    return M.heterogeneity(studies(spark, d), ["analysis"]).select("analysis", "k", r6("q").alias("q"), "df", r6("i2").alias("i2"), r6("tau2").alias("tau2"), r6("fixed").alias("fixed"))


def _rounded(df, keys):
    return df.select(*[c if c in keys or t in ("bigint", "int", "string") else r6(c).alias(c) for c, t in df.dtypes])


_POOL = "select {by}, count(*) k, round(sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)), 6) estimate, round(1 / sqrt(sum(1 / (vi + tau2))), 6) se, round(sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)) - {z} / sqrt(sum(1 / (vi + tau2))), 6) ci_low, round(sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)) + {z} / sqrt(sum(1 / (vi + tau2))), 6) ci_high, round(max(tau2), 6) tau2 from {src} group by {by}"


@query("pool_fixed", f"with {_ST}, x as (select *, 0.0::double tau2 from st) " + _POOL.format(by="analysis", z=Z, src="x"))
def pool_fixed(spark, d):
    return _rounded(M.pool(studies(spark, d), ["analysis"]), ["analysis"])


@query("pool_random", f"with {_ST}, h as (select analysis, {_TAU} tau2 from {_het('analysis')}), x as (select st.*, tau2 from st join h using (analysis)) " + _POOL.format(by="analysis", z=Z, src="x"))
def pool_random(spark, d):
    return _rounded(M.pool(studies(spark, d), ["analysis"], random=True), ["analysis"])


@query("study_weights", f"with {_ST}, h as (select analysis, {_TAU} tau2 from {_het('analysis')}) select analysis, study_id, round(1 / (vi + tau2) / sum(1 / (vi + tau2)) over (partition by analysis), 6) weight from st join h using (analysis)")
def study_weights(spark, d):
    return M.weights(studies(spark, d), ["analysis"], random=True).select("analysis", "study_id", r6("weight").alias("weight"))


@query("leave_one_out", f"with {_ST}, lo as (select a.analysis, a.study_id left_out, b.study_id, b.yi, b.vi, a.analysis || a.study_id g from st a join st b on a.analysis = b.analysis and a.study_id <> b.study_id), h as (select g, {_TAU} tau2 from {_het('g', 'lo')}), x as (select lo.*, tau2 from lo join h using (g)) " + _POOL.format(by="analysis, left_out", z=Z, src="x"))
def leave_one_out(spark, d):
    return _rounded(M.leave_one_out(studies(spark, d), ["analysis"]), ["analysis", "left_out"])


@query("subgroup_q", f"with {_ST}, t as {_het('analysis')}, i as (select analysis, sum(q) qw, count(*) - 1 dfb from (select analysis, q from {_het('analysis, subgroup')}) group by 1) select t.analysis, round(qw, 6) q_within, round(greatest(0, q - qw), 6) q_between, dfb df_between from t join i using (analysis)")
def subgroup_q(spark, d):
    return M.subgroups(studies(spark, d), ["analysis"]).select("analysis", r6("q_within").alias("q_within"), r6("q_between").alias("q_between"), "df_between")


@query("subgroup_p", f"with {_ST}, t as {_het('analysis')}, i as (select analysis, sum(q) qw, count(*) - 1 dfb from (select analysis, q from {_het('analysis, subgroup')}) group by 1), b as (select t.analysis, dfb, sqrt(greatest(0, q - qw)) u, unnest(range(0, 2001)) i from t join i using (analysis)) select analysis, round(case when any_value(dfb) > 0 then 1 - any_value(u) / 6000 * sum({_SIMPSON} * 2 * (u * i / 2000) ** (dfb - 1) * exp(-0.5 * (u * i / 2000) ** 2) / (2 ** (dfb / 2.0) * gamma(dfb / 2.0))) end, 6) p_between from b group by 1")
def subgroup_p(spark, d):
    """The SQL integrates the density of chi, whose square has the tail asked for."""
    return M.subgroups(studies(spark, d), ["analysis"]).select("analysis", r6("p_between").alias("p_between"))


_EG = f"with {_ST}, x as (select analysis, yi / sqrt(vi) y, 1 / sqrt(vi) x from st), s as (select analysis, count(*) k, regr_slope(y, x) b, regr_intercept(y, x) a, regr_sxx(y, x) sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) rss, avg(x) mx from x group by 1)"


@query("egger_intercept", f"{_EG} select analysis, k, round(b, 6) slope, round(a, 6) intercept, round(case when k >= 3 then a / sqrt(rss / (k - 2) * (1.0 / k + mx * mx / sxx)) end, 4) t from s")
def egger_intercept(spark, d):
    return M.egger(studies(spark, d), ["analysis"]).select("analysis", "k", r6("slope").alias("slope"), r6("intercept").alias("intercept"), F.round("t", 4).alias("t"))


@query("egger_p", f"{_EG}, z as (select analysis, k - 2 v, abs(case when k >= 3 then a / sqrt(rss / (k - 2) * (1.0 / k + mx * mx / sxx)) end) t, unnest(range(0, 2001)) i from s) select analysis, round(1 - 2 * any_value(t) / 6000 * sum({_SIMPSON} * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi()) * (1 + (t * i / 2000) ** 2 / v) ** (-(v + 1) / 2.0)), 6) p from z group by 1")
def egger_p(spark, d):
    """The SQL integrates the density of t by Simpson's rule."""
    return M.egger(studies(spark, d), ["analysis"]).select("analysis", r6("p").alias("p"))


@query("meta_regression", f"with {_ST}, a as (select analysis, count(*) k, sum(1/vi) s0, sum(moderator/vi) s1, sum(moderator*moderator/vi) s2, sum(yi/vi) t0, sum(moderator*yi/vi) t1, sum(yi*yi/vi) u, sum(1/vi/vi) v0, sum(moderator/vi/vi) v1, sum(moderator*moderator/vi/vi) v2 from st group by 1), b as (select *, s0*s2-s1*s1 det, (s0*t1-s1*t0)/(s0*s2-s1*s1) b1 from a), c as (select *, (t0-b1*s1)/s0 b0 from b), t as (select analysis, greatest(0, (u-b0*t0-b1*t1-(k-2))/(s0-(s2*v0-2*s1*v1+s0*v2)/det)) tau2 from c), w as (select st.*, tau2, 1/(vi+tau2) w from st join t using (analysis)), e as (select analysis, count(*) k, max(tau2) tau2, sum(w) s0, sum(w*moderator) s1, sum(w*moderator*moderator) s2, sum(w*yi) t0, sum(w*moderator*yi) t1 from w group by 1), f as (select *, s0*s2-s1*s1 det, (s0*t1-s1*t0)/(s0*s2-s1*s1) b1 from e) select analysis, k, round((t0-b1*s1)/s0, 4) intercept, round(b1, 4) slope, round(sqrt(s0/det), 4) se, round(b1/sqrt(s0/det), 4) z, round(tau2, 4) tau2 from f")
def meta_regression(spark, d):
    m = M.meta_regression(studies(spark, d), ["analysis"])
    return m.select("analysis", "k", *[F.round(c, 4).alias(c) for c in ("intercept", "slope", "se", "z", "tau2")])


@query("trim_and_fill")
def trim_and_fill(spark, d):
    return M.trim_and_fill(studies(spark, d), ["analysis"])
