"""Graph operators over edge DataFrames (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.names import builtin_names
from textquarry.storage import cut


def import_edges(files: DataFrame, known: DataFrame, extensions: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py")) -> DataFrame:
    """(source_file, target_file, import_type) of files (file, imports array of specifiers) among known (file).

    A relative specifier is resolved against its file's folder; the first candidate that exists is the target. Spark cannot tell how many
    paths follow from a table of keys, so neither side is broadcast.
    """
    from textquarry.functions.text import normal_path, parent_path

    spec = files.select(F.col("file").alias("source_file"), F.explode("imports").alias("spec")).distinct()
    base = F.when(F.col("spec").startswith("."), normal_path(F.concat_ws("/", parent_path(F.col("source_file")), F.col("spec")))).otherwise(normal_path(F.col("spec")))
    candidates = F.array(*[F.concat(base, F.lit(e)) for e in extensions])
    each = spec.select("source_file", "spec", F.posexplode(candidates).alias("priority", "target_file"))
    found = each.join(known.select(F.col("file").alias("target_file")).distinct().hint("merge"), "target_file")
    best = found.groupBy("source_file", "spec").agg(F.min_by("target_file", "priority").alias("target_file"))
    kind = F.when(F.lower("spec").contains("dynamic") | F.col("spec").contains("import("), "dynamic").otherwise("static")
    return best.where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.min(kind).alias("import_type"))


#: Fixed value: roots whose neighbours' neighbours are put together in one group, on average at most.
ROOTS_AT_ONCE = 512


def neighbourhood(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, direct_out, direct_in, indirect_out, indirect_in): sorted arrays; two hops without one hop or the root.

    All roots, or those given (root), in one plan. Ways of two edges are no rows: roots are dealt out in blocks, in the order of
    their least neighbours, to each of which the list of a neighbour that several of its roots have goes once, and a root's lists are put together there, for both
    directions at a time, so that no finished list is shuffled.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    kind = dict(e.dtypes)["src"]
    end = lambda a, b, out: e.select(F.col(a).alias("n"), F.col(b).alias("m"), F.lit(out).alias("out"))
    side = lambda out: F.array_sort(F.collect_list(F.when(F.col("out") == out, F.col("m"))))
    lists = cut(end("src", "dst", True).unionByName(end("dst", "src", False)).groupBy("n").agg(side(True).alias("outs"), side(False).alias("ins")))
    own, none = lists, F.array().cast(f"array<{kind}>")
    if roots is not None:
        own = roots.select(F.col("root").cast(kind).alias("n")).where("n is not null").distinct().join(lists, "n", "left").select("n", *[F.coalesce(c, none).alias(c) for c in ("outs", "ins")])
    blocks = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // ROOTS_AT_ONCE))
    least = F.least(F.array_min("outs"), F.array_min("ins"))  # roots near to each other often share it
    own = cut(own.repartitionByRange(blocks, least, "n").withColumn("block", F.spark_partition_id()))
    asked = lambda c: own.select("block", F.explode(c).alias("n"), F.lit(c == "outs").alias("out")).distinct()
    sent = asked("outs").unionByName(asked("ins")).join(lists, "n").select(F.col("block").alias("to"), "n", "out", F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins")).alias("ms"))
    columns = ", ".join(f"{c} array<{kind}>" for c in ("direct_out", "direct_in", "indirect_out", "indirect_in"))
    out = own.groupBy("block").cogroup(sent.where("size(ms) > 0").groupBy("to")).applyInArrow(_both_hops, f"root {kind}, {columns}")
    if roots is None:
        return out
    unnamed = roots.where("root is null").select(F.col("root").cast(kind).alias("root")).distinct()  # a null root has no neighbours
    return out.unionByName(unnamed.select("root", *[none.alias(c) for c in out.columns[1:]]))


def _both_hops(own, sent):
    """Rows (root, direct_out, direct_in, indirect_out, indirect_in) of own (n, outs, ins) and the lists sent (n, out, ms) of all their
    neighbours that have one in that direction."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = pa.list_(own.schema.field("outs").type.value_type)
    two = [_two_hops(own.column("n"), own.column(c), sent.filter(of), kind) for c, of in (("outs", sent.column("out")), ("ins", pc.invert(sent.column("out"))))]
    columns = [own.column("n"), own.column("outs").cast(kind), own.column("ins").cast(kind), *two]
    return pa.table(columns, names=["root", "direct_out", "direct_in", "indirect_out", "indirect_in"])


def _two_hops(nodes, ms, sent, kind):
    """What lies two hops from each of nodes, whose lists of one hop are ms, by the lists sent (n, ms)."""
    import numpy as np
    import pyarrow as pa

    def names(column):
        return column.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)

    def flat(lists):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy().astype(np.int64)
        return names(lists.flatten()), ends - ends[0]

    ones, cuts = flat(ms)
    values, ends = flat(sent.column("ms"))
    # Nodes by number, so that texts do as well as numbers.
    roots, at = names(nodes), names(sent.column("n"))
    known, code = np.unique(np.concatenate([roots, ones, values, at]), return_inverse=True)
    root_code, one_code, value_code, at_code = np.split(code, np.cumsum([len(roots), len(ones), len(values)]))
    row_of = np.full(len(known), -1)
    row_of[at_code] = np.arange(len(at_code))
    mark = np.zeros(len(known), bool)
    twos = []
    for i, root in enumerate(root_code):
        mine = one_code[cuts[i] : cuts[i + 1]]
        for j in row_of[mine]:
            if j >= 0:
                mark[value_code[ends[j] : ends[j + 1]]] = True
        mark[mine] = False
        mark[root] = False
        twos.append(known[np.flatnonzero(mark)])
        mark[:] = False
    sizes = np.r_[0, np.cumsum([len(x) for x in twos])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(twos) if twos else [], type=kind.value_type))


def hubs(edges: DataFrame, threshold: int, limit: int, most_importers: int = 10) -> DataFrame:
    """(node, n, importers): nodes with at least `threshold` distinct sources, most first.

    Counts come before lists: only the nodes that stay in the report have their sources gathered, `most_importers` each.
    """
    e = edges.select("src", "dst").distinct()
    top = e.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= threshold).orderBy(F.desc("n"), "dst").limit(limit)
    w = Window.partitionBy("dst").orderBy("src")
    first = e.join(F.broadcast(top), "dst").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most_importers)  # top has `limit` rows
    return first.groupBy("dst", "n").agg(F.array_sort(F.collect_list("src")).alias("importers")).withColumnRenamed("dst", "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their greatest node.

    Each round: nodes without an edge in or out go; the greatest node from which each can be reached goes along the edges as its
    colour; of each colour, those that can reach back to the node that gave it are a component. They go, and so do edges between
    colours, over which no cycle leads. Every step is a join and a partial aggregation; what a round leaves is written, and what it
    finds is never collected. A round walks as far as the longest of the shortest ways inside what is left.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        e = _trimmed(e)
        if not e.limit(1).count():
            break
        colour = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("changed"))
        while True:
            before = colour.select("node", "colour", F.col("colour").alias("was"))
            for _ in range(STEPS):
                told = before.join(e, F.col("node") == e.src).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
                before = before.join(told, "node", "left").select("node", F.greatest("colour", "new").alias("colour"), "was")
            colour = cut(before.select("node", "colour", (F.col("colour") > F.col("was")).alias("changed")))
            if not colour.where("changed").limit(1).count():
                break
        own = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst", "c")
        own = cut(own)
        reached, n = colour.where("node = colour").select("node", F.col("colour").alias("component")), 0
        while True:
            for _ in range(STEPS):
                back = reached.join(own, (F.col("node") == own.dst) & (F.col("component") == own.c)).select(F.col("src").alias("node"), "component")
                reached = reached.unionByName(back).distinct()
            reached = cut(reached)
            m = reached.count()
            if m == n:
                break
            n = m
        sizes = reached.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        new = cut(reached.join(sizes, "component", "left_semi").select("node", "component"))
        found = new if found is None else found.unionByName(new)
        gone = reached.select("node")
        e = cut(own.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        kind = dict(edges.dtypes)["src"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return found


#: Edges that colours go along before what they have reached is written.
STEPS = 3


def _trimmed(e: DataFrame, rounds: int = 2) -> DataFrame:
    """Without edges of nodes that have none in or none out; a few rounds, as colours settle what is left."""
    for _ in range(rounds):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return cut(e)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, component): the edges inside of components, which are all that cycles can use."""
    c = cut(components(edges))
    e = edges.where("src <> dst").select("src", "dst").distinct()
    inside = e.join(c.select(F.col("node").alias("src"), "component"), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst")
    return cut(inside.where("component = _c").select("src", "dst", "component"))


def cycles(edges: DataFrame, most: int = 6, few: int = 50_000) -> DataFrame:
    """(cycle, cycle_type): all simple cycles of up to `most` nodes, from their least node; direct: two nodes.

    Paths only visit nodes above their start, so each cycle is found once. Of more than `few` edges they stay inside strongly
    connected components; for fewer the search for components costs more than the paths that it saves, and the cycles are the same.
    """
    e = _trimmed(cut(edges.where("src <> dst").select("src", "dst").distinct()))
    if e.count() > few:
        e = cyclic_edges(e).select("src", "dst")
    paths = e.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    found = None
    for length in range(2, most + 1):
        closed = paths.join(e, (F.col("last") == e.src) & (F.col("start") == e.dst)).select(F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        if length < most:
            paths = cut(paths.join(e, F.col("last") == e.src).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path")))
            if not paths.limit(1).count():
                break
    return found.withColumn("cycle_type", F.when(F.size("cycle") == 2, "direct").otherwise("indirect"))


def bfs(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "callees", limit: int | None = None) -> DataFrame:
    """(root, node, depth): nodes within `depth` (1 to 5) steps with their least depth; the root is depth 0.

    direction: callees follows edges, callers goes against them, both does each on its own. With a limit, nodes near the
    root count first, then lesser ids.
    """
    depth = max(1, min(5, depth))
    ways = {"callees": [("src", "dst")], "callers": [("dst", "src")], "both": [("dst", "src"), ("src", "dst")]}[direction]
    out = None
    for a, b in ways:
        e = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
        seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
        front = seen
        for d in range(1, depth + 1):
            step = front.join(e, "node").select("root", F.col("next").alias("node")).distinct()
            front = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
            seen = seen.unionByName(front)
        out = seen if out is None else out.unionByName(seen)
    least = out.groupBy("root", "node").agg(F.min("depth").cast("int").alias("depth"))
    if limit is None:
        return least
    w = Window.partitionBy("root").orderBy("depth", "node")
    return least.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def endpoint_roles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, is_caller, is_callee) of nodes (node) by the edges that they start or end."""
    out = nodes.join(edges.select(F.col("src").alias("node")).distinct().withColumn("s", F.lit(True)), "node", "left").join(edges.select(F.col("dst").alias("node")).distinct().withColumn("t", F.lit(True)), "node", "left")
    return out.select("node", F.coalesce("s", F.lit(False)).alias("is_caller"), F.coalesce("t", F.lit(False)).alias("is_callee"))


#: Receivers that stand for the caller's own class, and those of which nothing is known.
OWN_RECEIVERS, UNKNOWN_RECEIVERS = ("this", "self"), ("<dynamic>", "<call_result>")


def resolve_calls(calls: DataFrame, symbols: DataFrame, skipped: frozenset[str] | None = None) -> DataFrame:
    """(src, dst, callee): calls (src, file, callee; receiver, is_method and is_dynamic if known) to symbols (id, file, symbol, line).

    Dynamic calls, calls of `skipped` names (`builtin_names` unless given) and calls through an unknown receiver resolve to
    nothing. A plain call goes to the same file before others, a method of the caller's own class to its file alone, and a
    method of a named receiver to a chunk that defines receiver and method, else to any that defines the method. Of equal
    priority the first line, then the lesser file and id decide. A call only ever needs the two best definitions of a
    name in its own file, with its receiver, and of all (one may be the caller itself), so those are ranked first, and a
    call meets six rows at most however often a name is defined.
    """
    skipped = builtin_names() if skipped is None else skipped
    for name, kind in (("receiver", "string"), ("is_method", "boolean"), ("is_dynamic", "boolean")):
        if name not in calls.columns:
            calls = calls.withColumn(name, F.lit(None).cast(kind))
    calls = calls.where(~F.coalesce("is_dynamic", F.lit(False)))
    if skipped:
        calls = calls.where(~F.col("callee").isin(*sorted(skipped)))
    method = F.coalesce("is_method", F.lit(False))
    kind = F.when(~method, "plain").when(F.col("receiver").isin(*OWN_RECEIVERS), "own").when(F.coalesce("receiver", F.lit("")).isin("", *UNKNOWN_RECEIVERS), "none").otherwise("named")
    calls = calls.withColumn("kind", kind).where("kind <> 'none'").select("src", "file", "callee", "receiver", "kind").distinct()
    s = symbols.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"), F.col("symbol").alias("callee"), "line").distinct()
    order = [F.col("line"), F.col("dst_file"), F.col("dst")]

    def best(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r <= 2").drop("_r")

    columns = ["src", "callee", "receiver", "kind", "dst", "line", "dst_file"]
    inside = calls.where("kind in ('plain', 'own')").join(best(s, "callee", "dst_file").withColumnRenamed("dst_file", "file"), ["callee", "file"]).withColumn("dst_file", F.col("file")).select(*columns, F.lit(0).alias("p"))
    # Chunks that define the receiver too, for the receivers and methods that are called.
    asked = calls.where("kind = 'named'").select("receiver", "callee").distinct()
    both = s.join(asked, "callee").join(symbols.select(F.col("id").alias("dst"), F.col("symbol").alias("receiver")).distinct(), ["dst", "receiver"])
    typed = calls.where("kind = 'named'").join(best(both, "receiver", "callee"), ["receiver", "callee"]).select(*columns, F.lit(0).alias("p"))
    other = calls.where("kind in ('plain', 'named')").join(best(s, "callee"), "callee").select(*columns, F.lit(1).alias("p"))
    ranked = inside.unionByName(typed).unionByName(other).where("src <> dst")
    one = ranked.groupBy("src", "callee", "receiver", "kind").agg(F.min(F.struct("p", "line", "dst_file", "dst")).alias("o"))
    return one.select("src", F.col("o.dst").alias("dst"), "callee").distinct()


def collapse_calls(resolved: DataFrame) -> DataFrame:
    """One edge per pair; the greatest callee name stands for several."""
    return resolved.groupBy("src", "dst").agg(F.max("callee").alias("callee"))


def reference_edges(chunks: DataFrame, symbols: DataFrame, key: str, text: str) -> DataFrame:
    """(src, dst): chunks whose text has another chunk's symbol as a token. An equi-join on tokens, no nested loop."""
    from textquarry.functions.text import TOKEN

    t = chunks.select(F.col(key).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0)))).alias("token"))
    s = symbols.select(F.col("id").alias("dst"), F.lower("symbol").alias("token")).distinct()
    return t.join(s, "token").where("src <> dst").select("src", "dst").distinct()


def impact_warnings(changed: DataFrame, edges: DataFrame, cycle_rows: DataFrame) -> DataFrame:
    """(file, warning, severity, n) for changed (file): high impact from 5 importers, hubs from 10, files in cycles."""
    importers = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n")).join(changed, "file", "left_semi")
    high = importers.where("n >= 5").select("file", F.lit("high_impact_change").alias("warning"), F.when(F.col("n") >= 10, "high").otherwise("medium").alias("severity"), "n")
    hub = importers.where("n >= 10").select("file", F.lit("hub_file").alias("warning"), F.when(F.col("n") >= 20, "critical").otherwise("high").alias("severity"), "n")
    in_cycle = cycle_rows.select(F.explode("cycle").alias("file"), F.size("cycle").alias("n")).join(changed, "file", "left_semi").groupBy("file").agg(F.min("n").cast("long").alias("n"))
    cyc = in_cycle.select("file", F.lit("circular_dependency").alias("warning"), F.when(F.col("n") == 2, "high").otherwise("medium").alias("severity"), "n")
    return high.unionByName(hub).unionByName(cyc)


def dependents_of(direct: str, indirect: str) -> Column:
    """The number of direct and indirect importers, beside their lists."""
    return (F.size(direct) + F.size(indirect)).cast("int")


def dependents(tree: DataFrame, threshold: int = 5) -> DataFrame:
    """(root, dependents, high_impact) from `neighbourhood` rows: direct and indirect importers."""
    n = dependents_of("direct_in", "indirect_in")
    return tree.select("root", n.alias("dependents"), (n >= threshold).alias("high_impact"))


def cascade_delete(files: DataFrame, chunks: DataFrame, relations: DataFrame, imports: DataFrame, gone: Column) -> dict[str, DataFrame]:
    """The four tables without the files that `gone` marks, their chunks, and edges that touch either."""
    lost_files = files.where(gone).select("file").distinct()
    lost_chunks = chunks.join(lost_files, "file", "left_semi").select("id")
    no_ends = relations.join(lost_chunks.withColumnRenamed("id", "src"), "src", "left_anti").join(lost_chunks.withColumnRenamed("id", "dst"), "dst", "left_anti")
    no_imports = imports.join(lost_files.withColumnRenamed("file", "source_file"), "source_file", "left_anti").join(lost_files.withColumnRenamed("file", "target_file"), "target_file", "left_anti")
    return {"files": files.join(lost_files, "file", "left_anti"), "chunks": chunks.join(lost_files, "file", "left_anti"), "relations": no_ends, "imports": no_imports}


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) of which an end is no node (id)."""
    ids = nodes.select(F.col("id"))
    no_src = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    no_dst = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return no_src.select("src", "dst").unionByName(no_dst.select("src", "dst")).distinct()
