"""Keyed state with timers against the batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textquarry.streaming import keyed as KS

START = datetime(2024, 1, 1)
JOBS = "repo string, branch string, job string, kind string, ts timestamp, seq long"
LOCKS = "feature string, owner string, kind string, ts timestamp, seq long"


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, KS.STORE)
    yield
    spark.conf.set(key, before)


def streamed(spark, folder, rows, schema, start, batches=3):
    """Rows in order in several files, each of which is a batch; the last batches only move time on."""
    step = -(-len(rows) // batches)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = []
    q = start(stream, f"{folder}/cp", lambda batch, _: got.extend(tuple(r) for r in batch.collect()))
    q.awaitTermination()
    return got


def test_jobs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(3)}", "main", f"j{i}", rng.choice(["enqueue", "enqueue", "start", "finish"]), START + timedelta(minutes=10 * i), i) for i in range(60)]
    late = START + timedelta(days=9)
    rows += [("other", "main", "x", "enqueue", late, 1000), ("other", "main", "y", "enqueue", late + timedelta(days=1), 1001)]
    got = streamed(spark, str(tmp_path), rows, JOBS, KS.job_stream)
    twin = sorted(tuple(r) for r in KS.job_decisions(spark.createDataFrame(rows, JOBS)).collect())
    assert sorted(r for r in got if r[4] != "forgotten") == twin and {r[4] for r in twin} == {"accepted", "duplicate"}
    # Every accepted job that something finished is forgotten, once.
    want = []
    for repo in {r[0] for r in rows}:
        active = None
        for r in (r for r in rows if r[0] == repo):
            if r[3] == "enqueue" and active is None:
                active = r[2]
            elif r[3] == "finish" and active is not None:
                want.append((repo, active))
                active = None
    assert sorted((r[0], r[2]) for r in got if r[4] == "forgotten") == sorted(want)


def test_locks(spark, tmp_path):
    rng = random.Random(6)
    at, rows = START, []
    for i in range(80):
        at += timedelta(minutes=rng.choice([1, 5, 12, 40]))
        rows.append((f"f{rng.randrange(3)}", f"o{rng.randrange(3)}", "release" if rng.random() < 0.15 else "acquire", at, i))
    rows += [("end", "o", "acquire", at + timedelta(days=2), 900), ("end", "o", "acquire", at + timedelta(days=3), 901)]
    got = streamed(spark, str(tmp_path), rows, LOCKS, KS.lock_stream, 4)
    twin = sorted(tuple(r) for r in KS.lock_decisions(spark.createDataFrame(rows, LOCKS)).collect())
    assert sorted(r for r in got if r[3] != "stale") == twin
    assert {"acquired", "renewed", "refused", "taken over", "released"} <= {r[3] for r in twin}
    # At the end each feature's lock is stale, which a timer has told, of its last holder.
    last = {f: [r for r in got if r[0] == f and r[3] == "stale"][-1][2] for f in ("f0", "f1", "f2")}
    held = {}
    for f, owner, kind, ts, seq in rows:
        held[f], _ = KS.lock_step(held.get(f), owner, kind, KS._ms(ts), 30 * 60_000)
    assert all(held[f] is None or last[f] == held[f][0] for f in last)


def test_lock_rules():
    ms = 30 * 60_000
    assert KS.lock_step(None, "a", "acquire", 5, ms) == (("a", 5), "acquired")
    assert KS.lock_step(("a", 5), "a", "acquire", 9, ms) == (("a", 9), "renewed")
    assert KS.lock_step(("a", 5), "b", "acquire", 5 + ms, ms) == (("a", 5), "refused")
    assert KS.lock_step(("a", 5), "b", "acquire", 6 + ms, ms) == (("b", 6 + ms), "taken over")
    assert KS.lock_step(("a", 5), "b", "release", 6, ms) == (("a", 5), "not held") and KS.lock_step(("a", 5), "a", "release", 6, ms) == (None, "released")


def test_twins_of_nothing(spark):
    assert KS.job_decisions(spark.createDataFrame([], JOBS)).count() == 0 and KS.lock_decisions(spark.createDataFrame([], LOCKS)).count() == 0
    one = spark.createDataFrame([("r", None, "j", "enqueue", START, 1), ("r", None, "k", "enqueue", START, 2)], JOBS)
    assert [r.decision for r in KS.job_decisions(one).orderBy(F.col("seq")).collect()] == ["accepted", "duplicate"]
