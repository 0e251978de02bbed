"""Sharding by k-d tree partitioning, in DataFrame operations alone.

A node that is to become m shards is cut at the weighted median (for odd m: at the weight share of its left half) along
its widest metadata dimension, until each leaf is one shard; the number of shards is given, or follows from the bytes
that a leaf may have. Cuts are found level by level for all nodes at once: the sizes of a node's rows are summed in at most
4,096 bins over the range of the order key, and the bin that holds the cut is looked into by the range of its own keys, so
no node's rows are ever sorted or gathered. The order key is the dimension, then the text's crc32, then a hash of the
id: equal texts lie side by side and only a group that a cut falls into is split. Nodes and cuts are tables that rows
meet by their node's number. What the driver sees is one row per node and step, and a node's bins are what one task orders.

Law: `bytes` (the shards' sizes are near equal). Slots number a shard's rows without gaps from 0.

Defined cases: a null or empty text has size 8 (the row's own 8 bytes) and crc32 0; null dimensions are value 0; rows with
the same id and text stay together, since nothing tells them apart; with fewer rows than shards some shards are empty; an
empty table gives no rows; columns other than those named are not read, and a table without a `lang` column is cut by length.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import cut, stored

SPAN, MOST = (1 << 31) - 1, (1 << 63) - 1
BIN_BITS = 12
STATE = "node int, dimension int, low long, span long, whole boolean, p1 long, from_key long, to_key long, shift int, want double"


@dataclass
class Node:
    """A node of the tree that becomes `shards` shards from number `first` on, and what is known of its cut."""

    first: int
    shards: int
    dimension: int = 0
    low: int = 0
    span: int = 1
    aim: float = 0.0
    want: float = 0.0
    #: The cut is looked for among the keys from low_key to high_key: of k1, or of k2 where k1 is p1.
    whole: bool = True
    p1: int = 0
    low_key: int = 0
    high_key: int = MOST
    #: Rows up to and with (c1, c2) go left.
    cut: tuple[int, int] | None = None

    def state(self) -> tuple:
        shift = max(0, (self.high_key - self.low_key).bit_length() - BIN_BITS)
        return (self.first, self.dimension, self.low, self.span, self.whole, self.p1, self.low_key, self.high_key, shift, self.want)

    def narrow(self, w: int, end: int, least: int, most: int, tolerance: float) -> None:
        """The bin with keys from `least` to `most` and weight w, `end` with all before it, holds the cut."""
        before = end - w
        if w > tolerance * self.aim and least < most:
            self.low_key, self.high_key, self.want = least, most, self.want - before
        elif w > tolerance * self.aim and self.whole:
            self.whole, self.p1, self.low_key, self.high_key, self.want = False, least, 0, MOST, self.want - before
        else:
            at = least - 1 if self.want - before < end - self.want else most
            self.cut = (at, MOST) if self.whole else (self.p1, at)


def _key(names: list[str]) -> Column:
    """The node's dimension scaled to 31 bits within the node, then the crc32."""
    value = F.element_at(F.array(*names), F.col("dimension") + 1)
    scaled = F.when(F.col("span") > 0, F.call_function("div", (value - F.col("low")) * F.lit(SPAN), F.col("span"))).otherwise(0)
    return F.shiftleft(scaled.cast("long"), 32).bitwiseOR(F.col("text_crc32"))


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table that is made in the JVM alone."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")))


def find_cuts(meta: DataFrame, names: list[str], nodes: list[Node], widths: list[int], tolerance: float) -> list[int]:
    """Fix the cuts of the nodes of a level. meta: node, size, text_crc32, k2 and the dimensions `names` as longs.

    Returns the ranges of the dimensions over all rows, which is what a node's own are compared with.
    """
    spark = meta.sparkSession
    ends = [f(d).alias(f"{d}_{s}") for d in names for f, s in ((F.min, "low"), (F.max, "high"))]
    found = {r.node: r for r in meta.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()}  # a row per node
    widths = widths or [max(1, found[0][f"{d}_high"] - found[0][f"{d}_low"]) if 0 in found else 1 for d in names]
    open_nodes = []
    for x in nodes:
        if r := found.get(x.first):  # without rows any cut is as good
            ranges = [r[f"{d}_high"] - r[f"{d}_low"] for d in names]
            x.dimension = max(range(len(names)), key=lambda i: ranges[i] / widths[i])
            x.low, x.span = r[f"{names[x.dimension]}_low"], ranges[x.dimension]
            x.aim = x.want = r["size"] * (x.shards // 2) / x.shards
            open_nodes.append(x)
    while open_nodes:
        state = _table(spark, [x.state() for x in open_nodes], STATE)
        rows = meta.join(F.broadcast(state), "node").withColumn("k1", _key(names))  # a row per node
        rows = rows.withColumn("k", F.when(F.col("whole"), F.col("k1")).when(F.col("k1") == F.col("p1"), F.col("k2"))).where("k between from_key and to_key")
        bins = rows.groupBy("node", F.expr("shiftright(k - from_key, shift)").alias("bin")).agg(F.sum("size").alias("w"), F.min("k").alias("least"), F.max("k").alias("most"), F.first("want").alias("want"))
        upto = bins.withColumn("end", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        held = upto.where("end >= want").groupBy("node").agg(F.min(F.struct("bin", "w", "end", "least", "most")).alias("c"))
        got = {r.node: r.c for r in held.collect()}  # a row per node
        for x in open_nodes:
            x.narrow(*got[x.first][1:], tolerance)
        open_nodes = [x for x in open_nodes if x.cut is None]
    return widths


def kd_tree(meta: DataFrame, names: list[str], shards: int, tolerance: float = 0.0005, levels_per_write: int = 3) -> tuple[DataFrame, list[list[Node]]]:
    """meta with `node`, the number of its shard, and the nodes that were cut, level by level.

    meta: size, text_crc32, k2 and the dimensions `names` as longs. After a few levels the rows' nodes are written.
    """
    meta, level, widths, tree = meta.withColumn("node", F.lit(0)), [Node(0, shards)], [], []
    while nodes := [x for x in level if x.shards > 1]:
        widths = find_cuts(meta, names, nodes, widths, tolerance)
        tree.append([x for x in nodes if x.cut])
        if tree[-1]:
            cuts = [(x.first, x.dimension, x.low, x.span, *x.cut, x.first + x.shards // 2) for x in tree[-1]]
            table = _table(meta.sparkSession, cuts, "node int, dimension int, low long, span long, c1 long, c2 long, right int")
            k1 = _key(names)
            right = (k1 > F.col("c1")) | ((k1 == F.col("c1")) & (F.col("k2") > F.col("c2")))
            meta = meta.join(F.broadcast(table), "node", "left").withColumn("node", F.when(right, F.col("right")).otherwise(F.col("node"))).select(*meta.columns)
            if len(tree) % levels_per_write == 0:
                meta = stored(meta, "nodes")
        level = [y for x in level for y in ((Node(x.first, x.shards // 2), Node(x.first + x.shards // 2, x.shards - x.shards // 2)) if x.shards > 1 else (x,))]
    return meta, tree


def document_meta(docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: dict[str, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, size, text_crc32, dimensions, k2) of docs, and the dimensions' names."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if dimensions is None:
        dimensions = ({"d_language": _two_letters(F.col("lang"))} if "lang" in docs.columns else {}) | {"d_length": _log_size(F.octet_length(body))}
    meta = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *(F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in dimensions.items()),
    )
    return meta.withColumn("k2", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 1)), list(dimensions)


def kd_shards(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shards: int | None = 24,
    target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None,
    rows_per_chunk: int = 50_000,
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    With `target_bytes` there are as many shards as leaves of at most that size need, else `shards`.
    """
    meta, names = document_meta(docs, key, text, dimensions)
    meta = stored(meta, "sizes")
    total = meta.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if target_bytes:
        shards = max(1, math.ceil(total.bytes / target_bytes))
    meta, _ = kd_tree(meta, names, shards)
    chunks = max(1, math.ceil(total.n / shards / rows_per_chunk))
    placed = cut(meta.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(chunks)).cast("int").alias("chunk")))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("rows"))
    bases = counts.select("shard", "chunk", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("number", number).join(bases, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _two_letters(c: Column) -> Column:
    return F.coalesce(F.ascii(c) * 256 + F.ascii(F.substring(c, 2, 1)), F.lit(0))


def _log_size(c: Column) -> Column:
    return F.floor(F.log2(c + F.lit(1.0)) * 1_000_000).cast("long")
