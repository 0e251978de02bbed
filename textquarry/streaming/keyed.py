"""Queues and locks as keyed state of a stream, with timers: `transformWithStateInPandas`. Each has a batch twin.

The state store must keep state by column family: set `spark.sql.streaming.stateStore.providerClass` to `STORE` in the session that
runs the streams. Rows of a key are taken in the order of ts and seq inside a batch, and batches as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Minutes after which a lock is stale, hours for which a finished job is remembered.
STALE_MINUTES, FINISHED_HOURS = 30, 24

JOBS_OUT = "repo string, branch string, job string, seq long, decision string"
LOCKS_OUT = "feature string, seq long, owner string, decision string"


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class JobQueue(StatefulProcessor):
    """Jobs of a repository and branch: one is pending or running at a time; another that is enqueued meanwhile is a duplicate.

    State: a map from job to its status, and a timer that forgets finished jobs after FINISHED_HOURS."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job string", "status string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out = []
        active = {k[0] for k, v in self.jobs.iterator() if v[0] != "finished"}
        for job, kind, ts, seq in frame[["job", "kind", "ts", "seq"]].itertuples(index=False):
            at = _ms(ts)
            if kind == "enqueue":
                out.append((*key, job, seq, "duplicate" if active else "accepted"))
                if not active:
                    active = {job}
                    self.jobs.updateValue((job,), ("pending", at))
            elif kind == "start" and job in active:
                self.jobs.updateValue((job,), ("processing", at))
            elif kind == "finish":
                for done in active:
                    self.jobs.updateValue((done,), ("finished", at))
                    self.handle.registerTimer(at + FINISHED_HOURS * 3_600_000)
                active = set()
        yield pd.DataFrame(out, columns=["repo", "branch", "job", "seq", "decision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, gone = expiredTimerInfo.getExpiryTimeInMs(), []
        for k, v in list(self.jobs.iterator()):
            if v[0] == "finished" and v[1] + FINISHED_HOURS * 3_600_000 <= now:
                self.jobs.removeKey(k)
                gone.append((*key, k[0], -1, "forgotten"))
        yield pd.DataFrame(gone, columns=["repo", "branch", "job", "seq", "decision"])

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], late: str = "0 seconds"):
    """Events (repo, branch, job, kind in enqueue, start, finish; ts timestamp, seq): a decision for each enqueued job, and a row
    `forgotten` for each finished job once its time is over."""
    keyed = events.withWatermark("ts", late).groupBy("repo", "branch")
    decided = keyed.transformWithStateInPandas(JobQueue(), JOBS_OUT, "Append", "EventTime")
    return decided.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_decisions(events: DataFrame) -> DataFrame:
    """The batch twin: an enqueued job is a duplicate if what came before it for its repository and branch was no finish."""
    w = Window.partitionBy("repo", "branch").orderBy("ts", "seq")
    told = events.where("kind in ('enqueue', 'finish')").withColumn("before", F.lag("kind").over(w))
    decision = F.when(F.coalesce(F.col("before"), F.lit("finish")) == "finish", "accepted").otherwise("duplicate")
    return told.where("kind = 'enqueue'").select("repo", "branch", "job", "seq", decision.alias("decision"))


def lock_step(held: tuple[str, int] | None, owner: str, kind: str, at: int, stale_ms: int) -> tuple[tuple[str, int] | None, str]:
    """What a lock (owner, since) becomes by an event, and the decision. A lock is stale after stale_ms; then another takes it over."""
    if kind == "release":
        mine = held is not None and held[0] == owner
        return (None if mine else held), ("released" if mine else "not held")
    if held is None:
        return (owner, at), "acquired"
    if held[0] == owner:
        return (owner, at), "renewed"
    if at - held[1] > stale_ms:
        return (owner, at), "taken over"
    return held, "refused"


class Locks(StatefulProcessor):
    """A lock per feature. A timer tells of a lock that has become stale; whoever asks next takes it over."""

    def __init__(self, minutes: int):
        self.stale_ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "owner string, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        held, out = (tuple(self.held.get()) if self.held.exists() else None), []
        for owner, kind, ts, seq in frame[["owner", "kind", "ts", "seq"]].itertuples(index=False):
            before = held
            held, decision = lock_step(held, owner, kind, _ms(ts), self.stale_ms)
            out.append((key[0], seq, owner, decision))
            if held is not None and held != before:
                self.handle.registerTimer(held[1] + self.stale_ms + 1)
        self.held.clear() if held is None else self.held.update(held)
        yield pd.DataFrame(out, columns=["feature", "seq", "owner", "decision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        due = held is not None and held[1] + self.stale_ms + 1 <= expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame([(key[0], -1, held[0], "stale")] if due else [], columns=["feature", "seq", "owner", "decision"])

    def close(self) -> None:
        pass


def lock_stream(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], minutes: int = STALE_MINUTES, late: str = "0 seconds"):
    """Events (feature, owner, kind in acquire, release; ts timestamp, seq): a decision for each, and a row `stale` when a lock becomes so."""
    keyed = events.withWatermark("ts", late).groupBy("feature")
    decided = keyed.transformWithStateInPandas(Locks(minutes), LOCKS_OUT, "Append", "EventTime")
    return decided.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lock_decisions(events: DataFrame, minutes: int = STALE_MINUTES) -> DataFrame:
    """The batch twin. A lock is one sequence of events, each of which depends on the one before, so a task walks through it; rows come
    sorted, and only the lock's holder is kept."""
    stale_ms = minutes * 60_000

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        held, out = None, []
        for feature, owner, kind, ts, seq in frame.sort_values(["ts", "seq"], kind="stable")[["feature", "owner", "kind", "ts", "seq"]].itertuples(index=False):
            held, decision = lock_step(held, owner, kind, _ms(ts), stale_ms)
            out.append((feature, seq, owner, decision))
        return pd.DataFrame(out, columns=["feature", "seq", "owner", "decision"])

    return events.select("feature", "owner", "kind", "ts", "seq").groupBy("feature").applyInPandas(walk, LOCKS_OUT)

