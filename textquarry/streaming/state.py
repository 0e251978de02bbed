"""Incremental and stateful operators: change sets, job queue, poll decisions, caches. Each stream has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base after changes (change in A, M, D; seq; base's columns): of a key the latest change counts; A and M put the
    row in place of what is there, D removes it, so replaying a change set changes nothing."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    last = changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    kept = base.join(last.select(*keys), keys, "left_anti").select(*base.columns)
    return kept.unionByName(last.where("change <> 'D'").select(*base.columns))


def change_counts(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row: added, modified, deleted, unchanged."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    last = changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "change")
    both = base.select(*keys).withColumn("_in", F.lit(True)).join(last, keys, "full_outer")
    return both.agg(
        F.count_if((F.col("change").isin("A", "M")) & F.col("_in").isNull()).alias("added"),
        F.count_if((F.col("change").isin("A", "M")) & F.col("_in")).alias("modified"),
        F.count_if((F.col("change") == "D") & F.col("_in")).alias("deleted"),
        F.count_if(F.col("change").isNull()).alias("unchanged"),
    )


def stream_changes(changes: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Apply a stream of changes batch by batch; merge(batch, id) must be repeatable, as a batch may come twice."""
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Files from which a job has low priority, and from which indexing goes to the background.
LOW_PRIORITY_FILES, BACKGROUND_FILES = 500, 100
PRIORITIES = ("high", "normal", "low")


def job_priority(file_count: Column, asked: Column) -> Column:
    return F.when(file_count > LOW_PRIORITY_FILES, "low").otherwise(F.coalesce(asked, F.lit("normal")))


def goes_to_background(file_count: Column) -> Column:
    return file_count > BACKGROUND_FILES


def latest_state(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def admissible_jobs(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs (repo, branch) without a pending or running one for the same repo and branch."""
    active = jobs.where(F.col("status").isin("pending", "processing")).select("repo", "branch")
    return new.join(active, ["repo", "branch"], "left_anti")


def next_jobs(jobs: DataFrame, n: int = 1, by: list[str] | None = None) -> DataFrame:
    """The next n pending jobs (per `by`): higher priority first, then the earlier."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2)
    pending = jobs.where("status = 'pending'")
    if not by:
        return pending.orderBy(rank, "enqueued_at", "id").limit(n)
    w = Window.partitionBy(*by).orderBy(rank, "enqueued_at", "id")
    return pending.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def expired(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Finished jobs older than `hours`."""
    return jobs.where(F.col("status").isin("completed", "failed") & (F.col("completed_at") < now - F.expr(f"interval {hours} hours")))


def poll_decisions(polls: DataFrame, key: str, head: str, order: list[str], failed: Column, findings: Column) -> DataFrame:
    """Per poll: drop after a permanent failure, skip an unchanged head, revalidate a moved one with findings, else review."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(head).over(w)
    dropped = F.coalesce(F.max(failed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    had = F.coalesce(F.lag(findings).over(w), F.lit(False))
    return polls.withColumn("decision", F.when(dropped, "drop").when(before == F.col(head), "skip").when(before.isNotNull() & had, "revalidate").otherwise("review"))


def poll_stream(polls: DataFrame, key: str, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """The stateful twin of poll_decisions for (key, seq, head, failed, findings): state per key in the state store."""
    schema = f"{key} string, seq long, decision string"

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        head, had, dropped = state.get if state.exists else (None, False, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, now, failed, findings in rows[["seq", "head", "failed", "findings"]].itertuples(index=False):
            out.append((k[0], seq, "drop" if dropped else "skip" if head == now else "revalidate" if head is not None and had else "review"))
            head, had, dropped = now, bool(findings), dropped or bool(failed)
        state.update((head, had, dropped))
        yield pd.DataFrame(out, columns=[key, "seq", "decision"])

    decided = polls.groupBy(key).applyInPandasWithState(decide, schema, "head string, had boolean, dropped boolean", "append", "NoTimeout")
    return decided.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_hits(requests: DataFrame, key: str, ts: str, seconds: int = 300) -> DataFrame:
    """Requests with hit: the same key was asked within the time before (each request renews it). For a cache without a bound."""
    w = Window.partitionBy(key).orderBy(ts)
    return requests.withColumn("hit", F.coalesce(F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double") <= seconds, F.lit(False)))


def lru_hits(requests: DataFrame, cache: str, key: str, order: list[str], ts: str, most: int = 100, seconds: int = 300) -> DataFrame:
    """Requests (cache, key, order, ts) with hit, of bounded caches: each holds its `most` keys last asked for, and a key from the
    miss that stored it for so many seconds. A cache is one sequence, so one task plays it, with `most` keys in memory."""
    from collections import OrderedDict

    fields = [cache, key, *order, *([ts] if ts not in order else [])]
    schema = ", ".join(f"{c} {dict(requests.dtypes)[c]}" for c in fields) + ", hit boolean"

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        held: OrderedDict = OrderedDict()
        hits = []
        for k, at in zip(rows[key], rows[ts]):
            until = held.pop(k, None)
            hit = until is not None and at <= until
            held[k] = until if hit else at + pd.Timedelta(seconds=seconds)
            if len(held) > most:
                held.popitem(last=False)
            hits.append(hit)
        return rows.assign(hit=hits)

    return requests.select(*fields).groupBy(cache).applyInPandas(play, schema)


def stale_locks(locks: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    return locks.where(F.col("acquired_at") < now - F.expr(f"interval {minutes} minutes"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling counts with a watermark; the same on a stream and on a table."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = timed.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def session_counts(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = timed.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")
