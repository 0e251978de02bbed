"""An inverted index that is kept up to date with its table: segments of postings, dead documents, and compaction.

A batch of changes adds a segment with the postings of its new and changed documents and a list of the older versions that are dead
from then on; nothing older is written again. A version row names the segments that count, with the number and total length
of living documents, so scores equal those of an index that is written anew. The row is written last: a batch that fails, or is
repeated before its row is there, leaves what was. Compaction merges segments of like size, when there are several, into one without
their dead documents; so a document is written again about once per size step.

Layout below a folder: postings/segment=/bucket=, sizes/segment=, dead/segment=, versions/version=.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions.text import tokens
from textquarry.operators.search import dealt, few, postings
from textquarry.storage import cut, fresh_dir

VERSION = "n long, total long, segments array<struct<id:int,docs:long>>, buckets int, layout string, kind string"


class SegmentedIndex:
    """For `index_scores`, `phrase_matches` and `cover_scores` the same as `Index`: key, n, average, of(terms)."""

    def __init__(self, spark: SparkSession, path: str, key: str, fan: int = 4):
        self.spark, self.path, self.key, self.fan = spark, path, key, fan
        self.refresh()

    @staticmethod
    def create(spark: SparkSession, path: str, key: str, kind: str = "long", buckets: int = 64, fan: int = 4) -> SegmentedIndex:
        """An index of no documents; `kind` is the key's type."""
        layout = f"`{key}` {kind}, doc_len int, term string, tf long, positions array<int>"
        first = spark.createDataFrame([(0, 0, [], buckets, layout, kind)], VERSION)
        first.coalesce(1).write.parquet(f"{path}/versions/version=0")
        return SegmentedIndex(spark, path, key, fan)

    def refresh(self) -> None:
        """Go to the last version; readers of an older one are not disturbed."""
        last = self.spark.read.schema(f"{VERSION}, version int").parquet(f"{self.path}/versions").orderBy(F.desc("version")).first()
        self.version, self.n, self.total, self.buckets, self.layout, self.kind = last.version, last.n, last.total, last.buckets, last.layout, last.kind
        self.segments = [(s.id, s.docs) for s in last.segments]
        self.average = self.total / self.n if self.n else None

    def _table(self, name: str, schema: str) -> DataFrame:
        """Rows of the segments that count, pruned by folder."""
        ids = [i for i, _ in self.segments]
        if not ids:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/segment={i}").withColumn("segment", F.lit(i)) for i in ids])

    def dead(self) -> DataFrame:
        """(segment, key): versions of documents that later segments have replaced or removed."""
        mine = self._table("dead", f"of int, `{self.key}` {self.kind}").select(F.col("of").alias("segment"), self.key)
        return mine.where(F.col("segment").isin([i for i, _ in self.segments])) if self.segments else mine

    def living(self) -> DataFrame:
        """(key, doc_len, segment) of the documents that count."""
        return self._table("sizes", f"`{self.key}` {self.kind}, doc_len int").join(few(self.dead()), ["segment", self.key], "left_anti")

    def of(self, terms: DataFrame, most: int = 5000) -> DataFrame:
        """Postings of the terms (term) in living documents; up to `most` terms are pushed down to folders and row groups."""
        rows = self._table("postings", f"{self.layout}, bucket int")
        asked = [r.term for r in terms.select("term").distinct().limit(most + 1).collect()]  # at most `most`
        if len(asked) > most:
            rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
        elif asked:
            number = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")
            wanted = [r.b for r in self.spark.createDataFrame([(x,) for x in asked], "term string").select(number).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(asked))
        else:
            rows = rows.limit(0)
        return rows.join(few(self.dead()), ["segment", self.key], "left_anti")

    def apply(self, changes: DataFrame, text: str = "text") -> None:
        """Changes (change in A, M, D; seq; key; text): of a key the latest counts. A and M put the document in place of what is there, D
        removes it, so a batch that comes again changes nothing but the number of segments. Null texts are documents without terms."""
        # Only changes of a key that has several are put in order; the texts of all others stay where they are.
        mine = changes.where(F.col(self.key).isNotNull()).select("change", "seq", F.col(self.key).cast(self.kind).alias(self.key), text)
        several = few(cut(mine.groupBy(self.key).agg(F.count("*").alias("_n")).where("_n > 1").select(self.key)))
        w = Window.partitionBy(self.key).orderBy(F.desc("seq"))
        latest = mine.join(several, self.key, "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        batch = fresh_dir(self.spark, "changes")  # compressed, where a cut would hold rows as they are
        mine.join(several, self.key, "left_anti").unionByName(latest).select("change", self.key, text).write.parquet(batch)
        last = self.spark.read.schema(f"change string, `{self.key}` {self.kind}, `{text}` string").parquet(batch)
        segment = self.version + 1
        gone = cut(self.living().join(few(last.select(self.key)), self.key, "left_semi").select(F.col("segment").alias("of"), self.key, "doc_len"))
        fresh = last.where("change <> 'D'").select(self.key, text)
        self._write_postings(postings(fresh, self.key, text), segment)
        fresh.select(self.key, F.size(tokens(F.col(text))).alias("doc_len")).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/sizes/segment={segment}")
        gone.select("of", self.key).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/dead/segment={segment}")
        out = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t")).first()
        new = self.spark.read.schema(f"`{self.key}` {self.kind}, doc_len int").parquet(f"{self.path}/sizes/segment={segment}").agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t")).first()
        self._commit(segment, self.n - out.n + new.n, self.total - out.t + new.t, [*self.segments, (segment, new.n)])
        self.compact()

    def _write_postings(self, rows: DataFrame, segment: int) -> None:
        dealt(rows, self.key, self.buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")

    def _commit(self, version: int, n: int, total: int, segments: list[tuple[int, int]]) -> None:
        row = self.spark.createDataFrame([(n, total, segments, self.buckets, self.layout, self.kind)], VERSION)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")
        self.refresh()

    def compact(self) -> None:
        """Merge segments while some size step has `fan` of them."""
        while True:
            steps: dict[int, list[int]] = {}
            for i, docs in self.segments:
                steps.setdefault(int(math.log(max(docs, 1), self.fan)), []).append(i)
            full = next((ids for _, ids in sorted(steps.items()) if len(ids) >= self.fan), None)
            if full is None:
                return
            segment = self.version + 1
            living = cut(self.living().where(F.col("segment").isin(full)))
            rows = self._table("postings", f"{self.layout}, bucket int").where(F.col("segment").isin(full)).join(few(self.dead()), ["segment", self.key], "left_anti")
            self._write_postings(rows.drop("segment", "bucket"), segment)
            living.select(self.key, "doc_len").coalesce(8).write.mode("overwrite").parquet(f"{self.path}/sizes/segment={segment}")
            # What the merged segments had said of others still holds; of them nothing needs to be said any more.
            others = [i for i, _ in self.segments if i not in full]
            said = self._table("dead", f"of int, `{self.key}` {self.kind}").where(F.col("segment").isin(full) & (F.col("of").isin(others) if others else F.lit(False)))
            said.select("of", self.key).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/dead/segment={segment}")
            self._commit(segment, self.n, self.total, [*((i, d) for i, d in self.segments if i not in full), (segment, living.count())])
