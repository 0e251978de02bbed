"""Mixing sources to target weights by hierarchical budgeting.

A tree has a level per column (domain, language, source) and integer weights. The token budget goes down level by level:
the children of a node share its budget in proportion to their weights; a child that holds less than its share is given
what it holds, and its siblings share the rest, so a shortage reaches a node's own siblings only when all below it is
used. What a leaf holds is its tokens times `max_epochs`. A leaf's budget is filled from seeded epochs: whole epochs
first, then the token-prefix of the next epoch's order, which sorts by md5(seed:epoch:doc_id).

Everything is a DataFrame: leaves are never collected, and a leaf's prefix is found from sums per hash bin, so only one
bin of a leaf is ever ordered by itself; that gives the leaf's last place, and every row is judged by comparing its own
place with it. All arithmetic is in whole numbers. Tokens are words between white space unless another count is given.

Defined cases: null level values are the branch "unknown"; a null or empty text has no tokens; rows with the same doc_id
stand or fall together within a leaf; a branch of weight 0 gets nothing; a leaf without tokens has
no budget and gives nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import cut

UNKNOWN = "unknown"


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    """Weight of a branch; "*" is that of branches not named."""
    out = F.lit(int(weights.get("*", 0)))
    for k, w in weights.items():
        if k != "*":
            out = F.when(name == k, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, weight, holds, and the parent's budget. Adds `given`: the node's own budget.

    Water-filling in one ordered pass: in order of holds per weight, a child is short as long as what it holds is at
    most its share of what is left; the others divide the remainder.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("ratio"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    rated = nodes.where("weight > 0 and holds > 0").withColumn("ratio", F.col("holds") / F.col("weight"))
    ranked = rated.select("*", F.coalesce(F.sum("holds").over(before), F.lit(0)).alias("held_before"), (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    marked = ranked.withColumn("short", F.expr("cast(holds as decimal(30,0)) * weight_left <= cast(weight as decimal(30,0)) * (budget - held_before)"))
    rest = marked.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("short"), F.col("holds"))).over(whole), F.lit(0)).alias("used"),
        F.coalesce(F.sum(F.when(~F.col("short"), F.col("weight"))).over(whole), F.lit(0)).alias("open_weight"),
    )
    share = F.expr("cast(floor(cast(weight as decimal(30,0)) * (budget - used) / open_weight) as long)")
    return rest.withColumn("given", F.when(F.col("short"), F.col("holds")).otherwise(F.least(share, F.col("holds")))).drop("ratio", "held_before", "weight_left", "short", "used", "open_weight")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget_share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves: level columns and tokens. Returns them with `given`, top-down through the levels."""
    held = leaves.withColumn("holds", F.col("tokens") * max_epochs)
    top = held.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * budget_share[0]).alias("x")).select(F.expr(f"x div {budget_share[1]}").alias("budget"))
    above: DataFrame = top.withColumn("_root", F.lit(0))
    parent = ["_root"]
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = held.withColumn("_root", F.lit(0)).groupBy("_root", *path).agg(F.sum("holds").alias("holds")).withColumn("weight", weight_of(F.col(level), weights[level]))
        given = share_out(nodes.join(above, parent), parent, level)
        above = given.select("_root", *path, F.col("given").alias("budget"))
        parent = ["_root", *path]
    return leaves.join(above.drop("_root"), levels, "left").withColumn("given", F.coalesce("budget", F.lit(0))).drop("budget")


def leaf_plan(rows: DataFrame, names: list[str], weights: dict[str, dict[str, int]], budget_share: tuple[int, int], max_epochs: int, seed: int, rows_per_bin: int) -> DataFrame:
    """rows: doc_id, level columns, tokens. Per leaf: full (whole epochs) and, where a part of the next epoch is taken, the
    last place of it: rows up to (last_h, last_id) in the epoch's order are taken once more; null: none."""
    per_leaf = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    plan = leaf_budgets(per_leaf, names, weights, budget_share, max_epochs)
    plan = cut(plan.select(*names, F.expr("case when tokens > 0 then given div tokens else 0 end").alias("full"), F.expr("case when tokens > 0 then given % tokens else 0 end").alias("rest")))
    digits = max(1, math.ceil(math.log(max(1, rows.count() / rows_per_bin), 16)))
    partial = plan.where("rest > 0")
    placed = rows.join(_few(partial), names).withColumn("h", order_key(seed)).withColumn("bin", F.substring("h", 1, digits))
    bins = placed.groupBy(*names, "bin").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    # The first bin whose end passes the rest is the one to look into; those before it are taken whole.
    ends = bins.withColumn("end", F.sum("t").over(Window.partitionBy(*names).orderBy("bin"))).where("end > rest")
    cross = cut(ends.groupBy(*names).agg(F.min(F.struct("bin", (F.col("end") - F.col("t")).alias("start"))).alias("x")).select(*names, F.col("x.bin").alias("bin"), F.col("x.start").alias("start")))
    upto = Window.partitionBy(*names).orderBy("h", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.join(_few(cross), [*names, "bin"]).withColumn("id", id_key("doc_id")).withColumn("fits", F.col("start") + F.sum("tokens").over(upto) <= F.col("rest"))
    last = inside.where("fits").groupBy(*names).agg(F.max(F.struct("h", "id")).alias("last"))
    # Where no row of that bin fits, all rows before it are taken: they sort below the bin's own digits.
    both = plan.join(cross.select(*names, "bin"), names, "left").join(last, names, "left")
    return cut(both.select(*names, "full", F.coalesce("last.h", "bin").alias("last_h"), F.coalesce("last.id", F.when(F.col("bin").isNotNull(), F.lit(""))).alias("last_id")))


def order_key(seed: int) -> Column:
    """The place of a row in the epoch `full` of its leaf."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def id_key(key: str) -> Column:
    """A text that tells ids with equal hashes apart; null is a value of its own."""
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def _few(leaves: DataFrame, most: int = 10_000) -> DataFrame:
    """Leaves, to be broadcast while they are at most `most`, so that a leaf with very many rows is not dealt to one task."""
    return F.broadcast(leaves) if leaves.limit(most + 1).count() <= most else leaves


def _copies(rows: DataFrame, plan: DataFrame, names: list[str], seed: int) -> DataFrame:
    """rows (doc_id, level columns, ...) with copies: how often each is taken. Rows only meet their leaf's row of the plan."""
    extra = F.struct(order_key(seed).alias("h"), id_key("doc_id").alias("id")) <= F.struct(F.col("last_h").alias("h"), F.col("last_id").alias("id"))
    found = rows.join(_few(plan), names)
    return found.withColumn("copies", (F.col("full") + F.when(F.col("last_h").isNotNull() & extra, 1).otherwise(0)).cast("int")).drop("full", "last_h", "last_id")


def _levelled(docs: DataFrame, levels: dict[str, Column], key: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(key).cast("long").alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(n) for n, c in levels.items()))


def mix(
    docs: DataFrame,
    *,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    budget_share: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    seed: int = 13,
    key: str = "doc_id",
    tokens: Column | None = None,
    rows_per_bin: int = 4000,
) -> DataFrame:
    """Per document: doc_id, the level columns, tokens, copies (how often it is taken; 0: not at all).

    budget_share is the token budget as a fraction (numerator, denominator) of all tokens in docs.
    """
    names = list(levels)
    rows = cut(_levelled(docs, levels, key, (word_count() if tokens is None else tokens).alias("tokens")))
    plan = leaf_plan(rows, names, weights, budget_share, max_epochs, seed, rows_per_bin)
    return _copies(rows, plan, names, seed).select("doc_id", *names, "tokens", "copies")


def mixed(
    docs: DataFrame,
    *,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    budget_share: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    seed: int = 13,
    key: str = "doc_id",
    tokens: Column | None = None,
    rows_per_bin: int = 4000,
) -> DataFrame:
    """The rows of docs that `mix` takes, each as often as it is taken, with all their columns. Texts are not shuffled."""
    names = list(levels)
    rows = cut(_levelled(docs, levels, key, (word_count() if tokens is None else tokens).alias("tokens")))
    plan = leaf_plan(rows, names, weights, budget_share, max_epochs, seed, rows_per_bin)
    taken = _copies(_levelled(docs, levels, key, F.struct(*docs.columns).alias("_row")), plan, names, seed).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies")).alias("_epoch")).select("_row.*")
