"""Cover density against all intervals, and the index that is kept up to date against one written anew."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import search as S
from textquarry.operators.segments import SegmentedIndex
from textquarry.storage import fresh_dir


def brute_covers(words, terms):
    """All intervals with every term and none such inside, by trying them all."""
    fits = {(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(terms) <= set(words[i : j + 1])}
    least = [(i, j) for i, j in fits if not any((p, q) != (i, j) and i <= p and q <= j for p, q in fits)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[i : j + 1])) for i, j in least)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(2)
    docs = {i: [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 18))] for i in range(80)}
    frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()] + [(98, ""), (99, None)], "doc_id long, text string")
    path = fresh_dir(spark, "cover")
    S.Index.write(frame, "doc_id", "text", path, buckets=4)
    return docs, S.Index(spark, path, "doc_id")


def test_covers_equal_all_intervals(spark, small):
    docs, index = small
    queries = {1: ["a"], 2: ["a", "b"], 3: ["c", "a", "d"], 4: ["a", "b", "c", "d"], 5: ["a", "zzz"], 6: ["b", "b", "a"]}
    frame = spark.createDataFrame(list(queries.items()), "query_id int, terms array<string>")
    got = {(r.query_id, r.doc_id): r.score for r in S.cover_scores(index, frame, every=True).collect()}
    want = {(q, i): brute_covers(ws, set(ts)) / math.log(1 + len(ws)) for q, ts in queries.items() for i, ws in docs.items() if set(ts) <= set(ws)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    any_ = {(r.query_id, r.doc_id): r.score for r in S.cover_scores(index, frame).collect()}
    want = {(q, i): 0.1 * sum(w in ts for w in ws) / math.log(1 + len(ws)) for q, ts in queries.items() for i, ws in docs.items() if set(ts) & set(ws)}
    assert any_.keys() == want.keys() and all(any_[k] == pytest.approx(want[k]) for k in want)


QUERIES = [(1, ["a", "b"]), (2, ["c"]), (3, ["zzz", "h"])]


def scores(spark, index):
    frame = spark.createDataFrame(QUERIES, "query_id int, terms array<string>")
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in S.index_scores(index, frame).collect()}


def anew(spark, table):
    path = fresh_dir(spark, "anew")
    S.Index.write(spark.createDataFrame([(k, t) for k, t in table.items()], "doc_id long, text string"), "doc_id", "text", path, buckets=4)
    return S.Index(spark, path, "doc_id")


def files_of(index):
    top = index.path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


CHANGES = "change string, seq int, doc_id long, text string"


@pytest.mark.parametrize("seed", range(2))
def test_any_batches_score_as_an_index_written_anew(spark, seed):
    rng = random.Random(seed)
    index = SegmentedIndex.create(spark, fresh_dir(spark, "seg"), "doc_id", buckets=4, fan=3)
    assert scores(spark, index) == {}
    table = {}
    for batch in range(6):
        rows = []
        for seq in range(1 if batch == 4 else 12):
            k = rng.randrange(25)
            change = rng.choice("AMD") if table else "A"
            text = None if rng.random() < 0.1 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9)))
            rows.append((change, seq, k, text))
            if change == "D":
                table.pop(k, None)
            else:
                table[k] = text
        index.apply(spark.createDataFrame(rows, CHANGES))
        if batch in (1, 3, 5):
            fresh = anew(spark, table)
            assert (index.n, index.average) == (fresh.n, pytest.approx(fresh.average)) and scores(spark, index) == scores(spark, fresh)
    assert len(index.segments) <= 5  # fan 3: a few per size step


def test_a_small_batch_writes_no_old_segment(spark):
    index = SegmentedIndex.create(spark, fresh_dir(spark, "seg"), "doc_id", buckets=4)
    index.apply(spark.range(300).select(F.lit("A").alias("change"), F.lit(0).alias("seq"), F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), (F.col("id") % 7).cast("string")).alias("text")))
    before = files_of(index)
    index.apply(spark.createDataFrame([("M", 0, i, "h changed") for i in range(10)], CHANGES))
    after = files_of(index)
    assert {k: after[k] for k in before} == before and len(after) > len(before)
    assert index.n == 300 and {k for q, k in scores(spark, index) if q == 3} == set(range(10))


def test_a_batch_that_comes_again_changes_no_score(spark):
    index = SegmentedIndex.create(spark, fresh_dir(spark, "seg"), "doc_id", buckets=4)
    batch = spark.createDataFrame([("A", 0, 1, "a b c"), ("A", 0, 2, "a h"), ("D", 1, 2, None), ("D", 0, 77, None), ("A", 0, None, "a")], CHANGES)
    index.apply(batch)
    once = scores(spark, index)
    index.apply(batch)
    assert scores(spark, index) == once and index.n == 1
    reader = SegmentedIndex(spark, index.path, "doc_id")
    assert scores(spark, reader) == once


def test_a_stream_of_changes(spark, tmp_path):
    from textquarry.streaming.state import stream_changes

    index = SegmentedIndex.create(spark, fresh_dir(spark, "seg"), "doc_id", buckets=4)
    for i, rows in enumerate(([("A", 0, 1, "a b"), ("A", 0, 2, "b b h")], [("M", 0, 1, "c"), ("D", 0, 2, None), ("A", 0, 3, "h a")])):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_changes(stream, lambda batch, _: index.apply(batch), f"{tmp_path}/cp").awaitTermination()
    assert scores(spark, index) == scores(spark, anew(spark, {1: "c", 3: "h a"}))
