"""Helpers that the operators share: the cluster's shared folder, lineage cuts and batch access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only in local mode, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so a lost executor costs no upstream work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as cut, as a compressed table: for many rows, of which a checkpoint would take several times the space."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, cut, and to be broadcast if a count shows that it has at most `most` rows (of a few numbers each)."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("string")


def batches(it: Iterator[pa.RecordBatch], key: str, text: str, most: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, UTF-8 texts) in groups of about `most` text bytes, so that a batch of long texts stays small."""
    keys: list = []
    texts: list[bytes] = []
    held = 0
    for batch in it:
        ids, column = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(text))
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        for k, t in zip(ids, raw):
            body = t.as_py() or b""
            keys.append(k.as_py())
            texts.append(body)
            held += len(body) + 64
            if held >= most:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of few rows for what runs inside, so that batches of long texts stay small on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
