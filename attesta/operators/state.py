"""Evidence state: decisions as event logs, claims with evidence, and constraints as queries for their violations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.lineage import cyclic
from attesta.store import written


def last_state(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The state after the last event of each key."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("events"))


def with_previous(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    return events.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))


def illegal_transitions(events: DataFrame, key: str, order: list[str], state: str, legal: set[tuple[str | None, str]]) -> DataFrame:
    """Events whose step from the state before is not in the table (None: the first event)."""
    known = F.lit(False)
    for a, b in sorted(legal, key=str):
        known = known | (F.col("from_state").eqNullSafe(F.lit(a)) & (F.col(state) == b))
    return with_previous(events, key, order, state).where(~F.coalesce(known, F.lit(False)))


def sequence_faults(events: DataFrame, key: str, arrival: str, seq: str) -> DataFrame:
    """Events whose number does not exceed every number before it."""
    top = F.max(seq).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("highest_before", top).where(F.col(seq) <= F.col("highest_before"))


def effective_verdict(decisions: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """The last correction's verdict, else the initial one."""
    last = corrections.groupBy(key).agg(F.max_by("verdict", "seq").alias("corrected"), F.count("*").alias("corrections"))
    return decisions.join(last, key, "left").select(key, F.coalesce("corrected", "verdict").alias("verdict"), F.coalesce("corrections", F.lit(0)).cast("long").alias("corrections"))


def claim_status(evidence: DataFrame, by: list[str]) -> DataFrame:
    """supports and contradicts: contested; contradicts: refuted; supports: supported; else unresolved."""
    s = evidence.groupBy(*by).agg(F.bool_or(F.col("stance") == "supports").alias("yes"), F.bool_or(F.col("stance") == "contradicts").alias("no"), F.count("*").alias("items"))
    return s.select(*by, F.when(F.col("yes") & F.col("no"), "contested").when(F.col("no"), "refuted").when(F.col("yes"), "supported").otherwise("unresolved").alias("status"), "items")


def settled_status(explicit: Column, derived: Column, contradicted: Column) -> Column:
    """An explicit status, which contradiction overrides and which without support falls back to unresolved."""
    return F.when(contradicted, derived).when((explicit == "supported") & (derived != "supported"), "unresolved").otherwise(F.coalesce(explicit, derived))


def demoted(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Two supported claims that contradict each other are both contested."""
    up = claims.where("status = 'supported'").select("claim")
    both = edges.where("relation = 'contradicts'").join(up.withColumnRenamed("claim", "src"), "src", "left_semi").join(up.withColumnRenamed("claim", "dst"), "dst", "left_semi")
    hit = both.select(F.col("src").alias("claim")).unionByName(both.select(F.col("dst").alias("claim"))).distinct().withColumn("hit", F.lit(True))
    return claims.join(hit, "claim", "left").select("claim", F.when(F.col("hit"), "contested").otherwise(F.col("status")).alias("status"))


def anchor_status(support: DataFrame, dangling: DataFrame) -> DataFrame:
    """support (claim, stance, resolved): invalid_graph if anything dangles, else conflicted, eligible or unsupported."""
    bad = dangling.limit(1).select(F.lit(True).alias("bad"))
    s = support.groupBy("claim").agg(F.count_if(F.col("stance") == "supports").alias("pos"), F.count_if(F.col("stance") == "contradicts").alias("neg"), F.count_if(~F.col("resolved")).alias("open"))
    s = s.join(F.broadcast(bad), F.lit(True), "left")  # one row at most
    return s.select("claim", F.when(F.col("bad"), "invalid_graph").when(F.col("neg") > 0, "conflicted").when((F.col("pos") > 0) & (F.col("open") == 0), "eligible").otherwise("unsupported").alias("anchor"))


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


#: A rule: the table it looks at, its name, the condition that breaks it.
RULES = [
    ("works", "blank_title", "title is null or trim(title) = ''"),
    ("artifacts", "bad_digest", "not coalesce(sha256 rlike '^[0-9a-f]{64}$', false)"),
    ("lineage", "self_loop", "child = parent"),
    ("lineage", "bad_relation", "relation not in ('derived_from', 'used', 'generated', 'supersedes')"),
    ("claims", "bad_status", "status not in ('supported', 'contested', 'refuted', 'unresolved')"),
    ("evidence", "bad_stance", "stance not in ('supports', 'contradicts', 'qualifies')"),
    ("decisions", "negative_without_basis", "negative_result and (basis is null or action <> 'negative_result')"),
]


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All broken rows of the tables given: rule, and the row's key (its first column). Empty means valid."""
    found = [tables[t].where(F.expr(cond)).select(F.lit(t).alias("table"), F.lit(rule).alias("rule"), F.col(tables[t].columns[0]).cast("string").alias("key")) for t, rule, cond in RULES if t in tables]
    return reduce(DataFrame.unionByName, found)


def lineage_cycles(edges: DataFrame) -> DataFrame:
    return cyclic(edges.where("child <> parent"))


def admission(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch (artifact_id, digest, kind), stored (artifact_id, digest): accepted, replayed or rejected with the error.

    An id that comes twice in a batch with different digests is rejected each time.
    """
    s = stored.select("artifact_id", F.col("digest").alias("stored"))
    kinds = batch.groupBy("artifact_id").agg(F.count_distinct("digest").alias("kinds"))
    b = batch.join(s, "artifact_id", "left").join(kinds, "artifact_id")
    error = F.when(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_digest").when(F.col("kinds") > 1, "collision_in_batch").when(F.col("stored").isNotNull() & (F.col("stored") != F.col("digest")), "collision")
    b = b.withColumn("error", error)
    return b.select("artifact_id", F.when(F.col("error").isNotNull(), "rejected").when(F.col("stored").isNotNull(), "replayed").otherwise("accepted").alias("status"), "error")


def ingest(batch: DataFrame, stored: DataFrame, atomic: bool = True) -> DataFrame:
    """Artifact rows to append: none of an atomic batch with a rejection, else those accepted."""
    marked = admission(batch, stored)
    ok = marked.where("status = 'accepted'").select("artifact_id").distinct()
    if atomic:
        bad = marked.where("status = 'rejected'").limit(1).select(F.lit(1).alias("bad"))
        ok = ok.join(F.broadcast(bad), F.lit(True), "left_anti")  # one row at most
    return batch.dropDuplicates(["artifact_id"]).join(ok, "artifact_id", "left_semi")


def table_digest(rows: DataFrame, fan: int = 16) -> DataFrame:
    """(rows, digest): the same for any order of the rows. A tree of digests: rows meet by the leading hex digits of their
    own digest, groups of about `fan` x 16 rows at the leaves whatever the table's size, and then 16 to one up to the root."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
    h = written(rows.select(F.sha2(F.concat_ws("\x1f", *cells), 256).alias("h")), "row-digests")
    n, depth = h.count(), 3
    while n > fan * 16 * 16**depth:
        depth += 1
    level = h.groupBy(F.left("h", F.lit(depth)).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    for length in range(depth - 1, -1, -1):
        one = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256)
        level = level.groupBy(F.left("g", F.lit(length)).alias("g")).agg(one.alias("d"), F.sum("n").alias("n"))
    return level.select(F.col("n").cast("long").alias("rows"), F.col("d").alias("digest"))


def stance_of(kind: Column, positives: Column, negatives: Column, total: Column) -> Column:
    """Stance of a receipt: any contradiction contradicts, all consistent supports, anything else qualifies."""
    return F.when(negatives > 0, "contradicts").when((total > 0) & (positives == total), "supports").otherwise("qualifies")


#: Stages of a reproduction checklist in order, those that gate any positive verdict, those that may be waived, the
#: statuses of a stage and the tiers (fixed values).
STAGES = ("identity", "code-link", "repo-identity", "version-consistency", "release-commit", "dataset", "model-weights", "dependencies", "license", "build-install", "smoke-run", "claimed-metrics", "measured-metrics", "metric-diff")
HARD = ("identity", "code-link", "repo-identity", "dependencies", "build-install", "smoke-run")
WAIVABLE = ("dataset", "model-weights", "license")
STATUSES = ("pass", "fail", "mismatch", "missing", "blocked", "skipped", "unknown")
NEGATIVE = ("fail", "missing", "blocked")
UNCHECKED = ("skipped", "unknown")
VERDICTS = ("reproducible", "partially-reproducible", "blocked", "inconsistent")
TIERS = ("no-code-found", "environment-broken", "runs", "direction-reproduced", "numbers-reproduced")


def checklist_errors(stages: DataFrame) -> DataFrame:
    """stages (paper, stage, status, waived, reason) -> paper, stage, error for every row that is no valid record.

    A paper is one row on the way: of each stage how many records it has and the union of their errors, as bits.
    """
    waived = F.coalesce("waived", F.lit(False))
    faults = {
        "invalid_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "waived_not_skipped": waived & (F.col("status") != "skipped"),
        "stage_not_waivable": waived & ~F.col("stage").isin(*WAIVABLE), "waived_without_reason": waived & (F.trim(F.coalesce("reason", F.lit(""))) == ""),
    }
    bits = reduce(Column.bitwiseOR, [F.when(hit, 1 << i).otherwise(0) for i, hit in enumerate(faults.values())])
    marked, known = stages.select("paper", "stage", bits.alias("bits")), F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))
    of = lambda s: F.col("stage") == s
    papers = marked.where(known).groupBy("paper").agg(*[x for i, s in enumerate(STAGES) for x in (F.count_if(of(s)).alias(f"n{i}"), F.bit_or(F.when(of(s), F.col("bits"))).alias(f"b{i}"))])
    wide = papers.select("paper", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("bits"), F.lit(True).alias("known")) for i, s in enumerate(STAGES)])).alias("x")).select("paper", "x.*")
    other = marked.where(~known).groupBy("paper", "stage").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bits").alias("bits")).withColumn("known", F.lit(False))
    found = [F.when(~F.col("known"), "unknown_stage"), F.when(F.col("n") > 1, "duplicate_stage"), *[F.when(F.col("bits").bitwiseAND(1 << i) > 0, rule) for i, rule in enumerate(faults)]]
    return wide.where("n > 0").unionByName(other).select("paper", "stage", F.explode(F.array_compact(F.array(*found))).alias("error"))


def checklist(stages: DataFrame) -> DataFrame:
    """stages (paper, stage, status, waived) -> paper, verdict, tier, contradictions, blocking, gaps.

    A stage without a record is unknown. Any mismatch makes a paper inconsistent; else a hard stage that did not pass
    blocks it; else it is reproducible where all others passed or were waived, and partially so where not. The
    tier says how far the run came, from facts alone: null where a needed stage is unchecked or the paper's identity
    failed. One row a paper that has records of known stages; of doubled records the first status by name counts.
    """
    # a record is a number: its status's place among the names (odd where it is one of them), then whether it is waived
    names = sorted(STATUSES)
    place = {name: 2 * i + 1 for i, name in enumerate(names)}
    before = reduce(Column.__add__, [F.when(F.col("status") > name, 2).otherwise(0) for name in names])
    code = F.when(F.col("status").isNull(), -1).otherwise(before + F.when(F.col("status").isin(*names), 1).otherwise(0))
    record = 2 * code + F.when(F.coalesce("waived", F.lit(False)), 1).otherwise(0)
    of = stages.where(F.col("stage").isin(*STAGES)).select("paper", "stage", record.alias("record"))
    by = of.groupBy("paper").agg(*[F.min(F.when(F.col("stage") == s, F.col("record"))).alias(f"r{i}") for i, s in enumerate(STAGES)])

    def has(stage: str, *statuses: str) -> Column:
        r = F.col(f"r{STAGES.index(stage)}")
        return F.coalesce(F.when(r >= 0, F.shiftright(r, 1)), F.lit(place["unknown"])).isin(*[place[x] for x in statuses])

    def named(stages_: tuple[str, ...], when: Callable[[str], Column]) -> Column:
        return F.array_compact(F.array(*[F.when(when(s), F.lit(s)) for s in stages_]))

    waived = lambda s: F.coalesce(F.col(f"r{STAGES.index(s)}") == 2 * place["skipped"] + 1, F.lit(False)) if s in WAIVABLE else F.lit(False)
    soft = tuple(s for s in STAGES if s not in HARD)
    out = by.select("*", named(STAGES, lambda s: has(s, "mismatch")).alias("contradictions"), named(HARD, lambda s: ~has(s, "pass")).alias("blocking"), named(soft, lambda s: ~has(s, "pass") & ~waived(s)).alias("gaps"))
    verdict = F.when(F.size("contradictions") > 0, "inconsistent").when(F.size("blocking") > 0, "blocked").when(F.size("gaps") == 0, "reproducible").otherwise("partially-reproducible")
    no, open_ = (lambda s: has(s, *NEGATIVE, "mismatch")), (lambda s: has(s, *UNCHECKED))
    tier = F.when(no("identity"), None).when(no("code-link") | no("repo-identity"), "no-code-found").when(open_("code-link") | open_("repo-identity") | open_("identity"), None)
    for s in ("dependencies", "build-install", "smoke-run"):
        tier = tier.when(has(s, *NEGATIVE), "environment-broken").when(open_(s), None)
    ran = has("claimed-metrics", "pass") & has("measured-metrics", "pass")
    tier = tier.when(ran & has("metric-diff", "pass"), "numbers-reproduced").when(ran & has("metric-diff", "fail"), "direction-reproduced").otherwise("runs")
    return out.select("paper", verdict.alias("verdict"), tier.alias("tier"), "contradictions", "blocking", "gaps")
