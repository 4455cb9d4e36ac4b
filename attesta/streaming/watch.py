"""Watch state per (watcher, item): observations that may come late, twice or out of order.

An observation has a sequence number, a status (retracted, not_retracted or unknown), signals, and whether these are
complete, cut short or failed. Of every number ever seen the first observation counts; the same again is a replay, another one a
conflict. One step function serves the batch and the stream. The batch finds replays and conflicts by aggregates, so of a key's history
only its first observations go through in order; the stream keeps a typed value and a map from number to digest in the state store, of
which it reads and writes only what a batch touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attesta.store import exists

KEYS = ("watcher", "item_key")
#: Columns of an observation besides its key; arrival orders those of a batch.
OBSERVATION = ("seq", "status", "signals", "signals_complete", "truncated", "error")
OUTCOMES = "watcher string, item_key string, seq long, outcome string, changed boolean, current_status string, confirmed string, version long"
FINAL = "watcher string, item_key string, current_status string, confirmed string, signals array<string>, applied long, confirmed_seq long, version long, truncated boolean, error string, stale long, replays long, conflicts long"
#: A key's state, as it is kept by the stream.
STATE = "current string, confirmed string, signals array<string>, applied long, confirmed_seq long, version long, truncated boolean, error string, stale long, replays long, conflicts long, reserved long"
_FIELDS = tuple(x.split()[0] for x in STATE.split(", "))
SERVED = "watcher string, item_key string, op string, arrival long, seq long, outcome string, changed boolean, current_status string, confirmed string, version long, signals array<string>"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def blank() -> dict:
    return {"current": None, "confirmed": None, "signals": [], "applied": -1, "confirmed_seq": -1, "version": 0, "truncated": False, "error": None, "stale": 0, "replays": 0, "conflicts": 0, "reserved": 0}


def step(s: dict, o: dict) -> tuple[str, bool]:
    """Apply the first observation of a number to state s in place; what became of it, and whether subscribers must hear of it."""
    seq, status, signals = int(o["seq"]), o["status"], sorted(set(o["signals"] or []))
    known = status != "unknown"
    if seq < (s["confirmed_seq"] if known else s["applied"]):
        s["stale"] += 1
        return "stale_ignored", False
    late, before = seq < s["applied"], s["signals"]
    if known:
        first, flipped = s["confirmed"] is None, s["confirmed"] not in (None, status)
        s["confirmed"], s["confirmed_seq"] = status, max(s["confirmed_seq"], seq)
        if not late:
            s["current"] = status
        s["signals"] = sorted({*before, *signals}) if late or not o["signals_complete"] else signals
        changed = first or flipped or s["signals"] != before
    else:
        s["current"] = "unknown"
        s["signals"] = sorted({*before, *signals}) if signals else before
        changed = s["signals"] != before
    if seq >= s["applied"]:
        s["truncated"], s["error"] = bool(o["truncated"]), o["error"]
    s["applied"] = max(s["applied"], seq)
    s["version"] += changed
    return "applied", changed


def digested(observations: DataFrame) -> DataFrame:
    """With digest: what two observations of one number are compared by."""
    signals = F.array_sort(F.array_distinct(F.coalesce("signals", F.array().cast("array<string>"))))
    return observations.withColumn("digest", F.md5(F.to_json(F.struct("status", signals.alias("s"), F.coalesce("signals_complete", F.lit(False)).alias("c"), F.coalesce("truncated", F.lit(False)).alias("t"), "error"))))


def _rows(pdf: pd.DataFrame) -> Iterator[dict]:
    for values in zip(*[pdf[c].tolist() for c in OBSERVATION], strict=True):
        r = dict(zip(OBSERVATION, values, strict=True))
        r["signals"] = [] if r["signals"] is None else list(r["signals"])
        r["error"] = r["error"] if isinstance(r["error"], str) else None
        yield r


def fold(observations: DataFrame) -> DataFrame:
    """The state of every key after its observations, in order of `arrival` (of equal arrivals the lesser digest is first).

    First observations are sorted by key and arrival and passed through the step function as they come, so that of a key's
    history only a batch is held, however long it is. An empty table gives no rows.
    """
    rows = digested(observations.select(*KEYS, "arrival", *OBSERVATION))
    alike = rows.groupBy(*KEYS, "seq", "digest").agg(F.min_by(F.struct("arrival", *OBSERVATION[1:]), "arrival").alias("o"), F.count("*").alias("n"))
    first = F.min_by(F.struct("o", "n"), F.struct("o.arrival", "digest"))
    firsts = alike.groupBy(*KEYS, "seq").agg(first.alias("f"), F.sum("n").alias("n")).select(*KEYS, "seq", "f.o.*", (F.col("f.n") - 1).alias("replays"), (F.col("n") - F.col("f.n")).alias("conflicts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s = None, blank()
        for pdf in batches:
            out = []
            for now, o, replays, conflicts in zip(zip(*[pdf[k].tolist() for k in KEYS]), _rows(pdf), pdf["replays"], pdf["conflicts"], strict=True):
                if now != key:
                    if key is not None:
                        out.append(_final(key, s))
                    key, s = now, blank()
                step(s, o)
                s["replays"] += replays
                s["conflicts"] += conflicts
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([_final(key, s)])

    # by number, so that small inputs are not gathered in one task of Python
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return firsts.repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "arrival", "seq").mapInPandas(run, FINAL)


def _final(key: tuple, s: dict) -> dict:
    kept = ("confirmed", "signals", "applied", "confirmed_seq", "version", "truncated", "error", "stale", "replays", "conflicts")
    return dict(zip(KEYS, key, strict=True)) | {"current_status": s["current"]} | {k: s[k] for k in kept}


class Keeper(StatefulProcessor):
    """Reserves numbers, commits observations and drains changes of one key at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)
        self.commits = handle.getMapState("commits", "seq long", "digest string")
        self.outbox = handle.getMapState("outbox", "version long", "seq long, current string, confirmed string, signals array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else blank()
        s["signals"] = list(s["signals"] or [])
        for pdf in rows:
            pdf, out = pdf.sort_values("arrival", kind="stable"), []
            for op, arrival, digest, o in zip(pdf["op"].tolist(), pdf["arrival"].tolist(), pdf["digest"].tolist(), _rows(pdf), strict=True):
                out += [(*key, op, arrival, *x) for x in self.one(s, op, digest, o)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SERVED.split(", ")]).astype({"seq": "Int64", "version": "Int64", "arrival": "Int64"})
        self.state.update(tuple(s[f] for f in _FIELDS))

    def one(self, s: dict, op: str, digest: str, o: dict) -> list[tuple]:
        said = lambda seq, outcome, changed=False: (seq, outcome, changed, s["current"], s["confirmed"], s["version"], list(s["signals"]))
        if op == "reserve":
            s["reserved"] += 1
            return [said(s["reserved"], "reserved")]
        if op == "drain":
            waiting = sorted((int(v[0]), x) for v, x in self.outbox.iterator())
            for version, _ in waiting:
                self.outbox.removeKey((version,))
            return [(int(x[0]), "delta", True, x[1], x[2], version, list(x[3])) for version, x in waiting]
        seq = int(o["seq"])
        if self.commits.containsKey((seq,)):
            same = self.commits.getValue((seq,))[0] == digest
            s["replays" if same else "conflicts"] += 1
            return [said(seq, "replayed" if same else "conflict")]
        self.commits.updateValue((seq,), (digest,))
        outcome, changed = step(s, o)
        if changed:
            self.outbox.updateValue((s["version"],), (seq, s["current"], s["confirmed"], list(s["signals"])))
        return [said(seq, outcome, changed)]

    def close(self) -> None:
        pass


def serve(requests: DataFrame) -> DataFrame:
    """A streaming DataFrame of requests (watcher, item_key, op, arrival, and an observation's columns) -> what became of each, in
    append mode.

    op reserve gives the key's next number; commit applies an observation, a number seen before being a replay or a
    conflict at any age; drain gives the changes not drained yet, a row each, and takes them out. Requests of a key are
    served in order of arrival inside a batch. No watermark: a late known observation still updates the confirmed status, so a key's
    state is kept for good, with one entry in its map for every number. A restart goes on where the checkpoint ends.
    """
    keep_states(requests.sparkSession)
    rows = digested(requests.select(*KEYS, "op", "arrival", *OBSERVATION))
    return rows.groupBy(*KEYS).transformWithStateInPandas(Keeper(), SERVED, "append", "none")


def keep_states(spark: SparkSession) -> None:
    """State in RocksDB: on the executors' disks and in the checkpoint, not in their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def stream(observations: DataFrame) -> DataFrame:
    """A streaming DataFrame of observations -> what became of each: requests that only commit (see serve)."""
    return serve(observations.withColumn("op", F.lit("commit"))).select(*[x.split()[0] for x in OUTCOMES.split(", ")])


def reserve(requests: DataFrame, last: DataFrame) -> DataFrame:
    """requests (watcher, item_key, arrival), last (watcher, item_key, reserved) -> the next numbers of each key."""
    w = Window.partitionBy(*KEYS).orderBy("arrival")
    return requests.join(last, list(KEYS), "left").withColumn("seq", F.coalesce("reserved", F.lit(0)) + F.row_number().over(w)).drop("reserved")


def unacknowledged(outcomes: DataFrame, acked: DataFrame) -> DataFrame:
    """Changes whose version no acknowledgement (watcher, item_key, version) covers."""
    top = acked.groupBy(*KEYS).agg(F.max("version").alias("acked"))
    return outcomes.where("changed").join(top, list(KEYS), "left").where("version > coalesce(acked, 0)").drop("acked")


def drain(outcomes: DataFrame, path: str, buckets: int = 64) -> None:
    """For foreachBatch: append the batch's changes that the outbox at path lacks, by (key, version).

    The outbox is laid out by buckets of keys, of which only those that the batch touches are read.
    """
    spark = outcomes.sparkSession
    new = outcomes.where("changed").dropDuplicates([*KEYS, "version"]).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets` rows
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*KEYS, "version")
        new = new.join(old, [*KEYS, "version"], "left_anti")
    new.write.mode("append").partitionBy("bucket").parquet(path)


def retraction_status(rows: DataFrame) -> DataFrame:
    """rows (item, flag boolean, notice boolean, complete boolean) by provider batch -> status and partial coverage."""
    s = rows.groupBy("item").agg(F.bool_or("flag").alias("flag"), F.bool_or("notice").alias("notice"), F.bool_and("complete").alias("complete"))
    status = F.when(F.coalesce("flag", F.lit(False)) | F.coalesce("notice", F.lit(False)), "retracted").when((~F.col("flag")) & F.col("complete"), "not_retracted").otherwise("unknown")
    return s.select("item", status.alias("status"), (~F.coalesce("complete", F.lit(False))).alias("partial_coverage"))


#: Update types that retract a work (fixed values).
RETRACTING = ("retraction", "withdrawal", "removal", "expression_of_concern", "expression-of-concern")


def update_signals(updates: DataFrame) -> DataFrame:
    """updates (notice, doi, update_type) -> retracting signals by target DOI, sorted and distinct."""
    hit = updates.where(F.lower("update_type").isin(*RETRACTING))
    return hit.groupBy("doi").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", F.lower("update_type"), F.col("notice").cast("string")))), "|").alias("signals"), F.count("*").alias("n"))


def first_seen_stream(items: DataFrame, key: str = "item_key") -> DataFrame:
    """Each key once, the first time it comes (state grows with the keys)."""
    return items.dropDuplicates([key])
