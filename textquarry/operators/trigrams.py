"""A stored index of three-character strings, so that a pattern is only looked for in texts that can match it.

From a pattern follows what every match holds: runs of plain characters, of one of several branches, of what must occur. A text
with a match has all trigrams of one such alternative. The index has, for each trigram of the lower-cased text, the texts that
hold it, in folders by bucket and sorted; texts lie beside it in blocks by key. A search reads the trigrams of its pattern, then the
blocks of the texts that have them. It finds what a scan finds: a pattern of which nothing follows reads all blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alternatives that are kept apart, and trigrams asked of one; beyond these less is asked, which finds the same with more reading.
MOST_WAYS, MOST_GRAMS, MOST_BLOCKS = 24, 24, 5000


def needed(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of which each match has all trigrams of one, lower-cased; None where nothing is known.

    The pattern is read as Python reads it. What Python cannot read, and case-insensitive matching beyond ASCII, tells nothing.
    """
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if re.search(r"\(\?[a-z]*u", pattern):
        return None
    ways = _ways(tree)
    return None if any(not w for w in ways) else [frozenset(sorted(w)[:MOST_GRAMS]) for w in ways]


def _ways(tree) -> list[frozenset[str]]:
    ways, run = [frozenset()], ""

    def also(more: list[frozenset[str]]) -> None:
        nonlocal ways
        both = list(dict.fromkeys(a | b for a in ways for b in more))
        if all(more) and len(both) <= MOST_WAYS:
            ways = both

    def end() -> None:
        nonlocal run
        if len(run) >= 3:
            also([frozenset(run[i : i + 3] for i in range(len(run) - 2))])
        run = ""

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            kind = str(op)
            if kind == "LITERAL" and 0x20 <= value < 0x7F:
                run += chr(value).lower()
            elif kind == "SUBPATTERN":
                walk(value[3])
            elif kind == "ATOMIC_GROUP":
                walk(value)
            elif kind != "AT":  # places take no characters, so a run goes on over them
                end()
                if kind == "BRANCH":
                    also([w for branch in value[1] for w in _ways(branch)])
                elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                    also(_ways(value[2]))

    walk(tree)
    end()
    return ways


def _lists(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """(gram, block, keys) of texts (key, block, grams), `most` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            key, block, grams = batch.slice(at, most).columns
            text = pc.list_parent_indices(grams)
            each = pa.table({"gram": grams.flatten(), "block": block.take(text), "keys": key.take(text)})
            made = each.group_by(["gram", "block"], use_threads=False).aggregate([("keys", "list")])
            yield from made.rename_columns({"keys_list": "keys"}).select(["gram", "block", "keys"]).to_batches(20_000)


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str, key: str, text: str):
        self.spark, self.path, self.key, self.text = spark, path, key, text
        self.buckets = spark.read.parquet(f"{path}/figures").first().buckets

    @staticmethod
    def write(docs: DataFrame, key: str, text: str, path: str, buckets: int = 64, blocks: int = 64) -> TrigramIndex:
        """Texts in `blocks` folders by key's hash, trigrams in `buckets`. A text's trigrams are made distinct where it is read, and
        the texts that share one are listed there, so what is dealt out is a key for each, not a row."""
        spark = docs.sparkSession
        placed = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
        placed.repartition("block").sortWithinPartitions("block", key).write.partitionBy("block").parquet(f"{path}/texts")
        low = F.lower(text)
        gram = F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(.{3}))"), F.lit(1)))  # in one walk over the text
        held = spark.read.parquet(f"{path}/texts").where(F.length(low) >= 3).select(F.col(key), "block", gram.alias("grams"))
        lists = held.mapInArrow(_lists, f"gram string, block int, keys array<{dict(docs.dtypes)[key]}>")
        rows = lists.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        # By hash, as a range would be sampled first, for which all lists would be made twice; a frequent trigram goes to four tasks.
        rows.repartition("bucket", F.col("block") % 4).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/figures")
        return TrigramIndex(spark, path, key, text)

    def texts(self, pattern: str, *, fixed: bool = False) -> DataFrame:
        """(key, text) of all texts that can match, and few others."""
        everything = self.spark.read.parquet(f"{self.path}/texts")
        ways = needed(re.escape(pattern) if fixed else pattern)
        if ways is None:
            return everything.select(self.key, self.text)
        asked = self.spark.createDataFrame([(i, g, len(w)) for i, w in enumerate(ways) for g in w], "way int, gram string, n int")
        grams = sorted({g for w in ways for g in w})
        numbers = [r.b for r in asked.select(F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # of one pattern
        held = self.spark.read.parquet(f"{self.path}/grams").where(F.col("bucket").isin(numbers) & F.col("gram").isin(grams))
        # The alternatives of one pattern: a few hundred rows at most.
        full = held.join(F.broadcast(asked), "gram").select("way", "n", "block", F.explode("keys").alias(self.key)).groupBy("way", self.key, "block").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c = n")
        found = full.select(self.key, "block").distinct()
        blocks = [r.block for r in found.select("block").distinct().limit(MOST_BLOCKS + 1).collect()]
        read = everything.where(F.col("block").isin(blocks)) if len(blocks) <= MOST_BLOCKS else everything
        return read.join(found, [self.key, "block"], "left_semi").select(self.key, self.text)

    def grep(self, pattern: str, limit: int | None = None, *, fixed: bool = False, word: bool = False) -> DataFrame:
        from textquarry.operators.search import grep

        return grep(self.texts(pattern, fixed=fixed), self.key, self.text, pattern, limit, fixed=fixed, word=word)

