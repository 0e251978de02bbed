"""Ranked, running and gap computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: str, score: str, key: str, n: int, removed: bool = False) -> DataFrame:
    """The n best rows of each group with their rank; with `removed` also how many rows the group lost."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key))
    best = df.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n)
    if not removed:
        return best
    lost = df.groupBy(group).agg(F.greatest(F.lit(0), F.count("*") - n).cast("int").alias("removed"))
    return best.join(lost, group)


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def estimated_tokens(text: Column, overhead: int = 50) -> Column:
    return F.ceil(F.length(text) / 4) + overhead


def token_budget(df: DataFrame, cost: Column, order: list[Column], budget: int, most_rows: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The longest prefix of the order whose cost fits the budget; it stops at the first that does not fit.

    Without `by` the candidates of one request are meant: cap them first (`most_rows`), as all go through one window.
    """
    if most_rows is not None and not by:
        df = df.orderBy(*order).limit(most_rows)
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def coverage_gaps(ranges: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, gap_start, gap_end): stretches between covered ranges."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_reach", reach).where(F.col(start) > F.col("_reach") + 1).select(group, (F.col("_reach") + 1).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))


def similarity_to_previous(df: DataFrame, group: str, order: Column | list[Column], similarity, derived: dict[str, Column] | None = None) -> DataFrame:
    """similarity(previous row's struct, row's struct) along the order of each group; null for the first.

    A group may be most of the table: rows are dealt out by ranges of group and order, and the last row of a range is handed to the
    group's next one. `derived` names columns that are computed where a range arrives, once a row; they stand in place of those that
    they are computed from, where these have the same name, and in the result.
    """
    order = order if isinstance(order, list) else [order]
    ranged = df.repartitionByRange(F.col(group), *order).withColumn("_place", F.struct(F.spark_partition_id().alias("part"), F.col(group).alias("group")))
    placed = ranged.withColumns(derived or {})
    w = Window.partitionBy("_place").orderBy(*order)
    row = F.struct(*[c for c in placed.columns if c != "_place"])
    marked = placed.withColumn("_row", row).withColumn("_before", F.lag("_row").over(w)).withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
    follows = F.lead("_place").over(Window.partitionBy("_place.group").orderBy("_place.part"))  # one row per range and group
    handed = marked.where("_last").select(follows.alias("_place"), F.col("_row").alias("_handed")).where("_place is not null")
    both = marked.join(handed, "_place", "left").withColumn("_before", F.coalesce("_before", "_handed"))
    return both.withColumn("similarity", F.when(F.col("_before").isNotNull(), similarity(F.col("_before"), F.col("_row")))).drop("_place", "_row", "_before", "_last", "_handed")


def first_wins(parts: list[DataFrame], keys: list[str], tie: list[str]) -> DataFrame:
    """Concatenation with the first part's row of each key."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        both = p if both is None else both.unionByName(p)
    w = Window.partitionBy(*keys).orderBy("part", *tie)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
