"""Properties and small cases that SQL does not show."""

import itertools
import random

from pyspark.sql import functions as F

from textquarry.operators import chunking as C
from textquarry.operators import diffs as D
from textquarry.operators import findings as FN
from textquarry.operators import graph as G
from textquarry.operators import search as S
from textquarry.operators import similarity as SIM
from textquarry.operators import windows as W
from textquarry.sources import files as FS
from textquarry.streaming import state as ST


def test_parse_diff_pairs_modifications():
    lines = D.parse_diff("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,4 +1,4 @@\n a\n-b\n-c\n+B\n d\n+e")
    assert [(x["change"], x["line"], x["side"]) for x in lines] == [("modification", 2, "new"), ("deletion", 3, "old"), ("addition", 4, "new")]


def test_parse_diff_keeps_marks_inside_hunks():
    lines = D.parse_diff("--- a/x\n+++ b/x\n@@ -1,1 +1,2 @@\n---- old\n++++ new\n+z")
    assert [(x["change"], x["content"]) for x in lines] == [("modification", "+++ new"), ("addition", "z")]


def test_chunks_cover_python_file():
    code = "import a\n\n# note\ndef f():\n    return 1\n\nx = 2\n\nclass K:\n    def m(self):\n        pass\n"
    chunks = C.chunk_source(code, "python")
    assert [(c["location"], c["chunk_type"]) for c in chunks] == [("3-5", "function"), ("9-11", "class"), ("1-2", "other"), ("6-8", "other")]
    assert chunks[1]["symbol_names"] == ["K", "m"]
    assert C.chunk_source("  \n", "python") == []
    assert C.chunk_source("x = 1", "python")[0]["chunk_type"] == "module"
    assert C.chunk_source("def broken(:", "python")[0]["chunk_type"] == "fallback"


def test_calls_skip_strings_and_comments():
    calls = C.calls_in("// no()\nconst a = b.c(1, 'x()')\nif (d()) { e?.f() }", "typescript")
    assert [(c["callee"], c["receiver"], c["line"]) for c in calls] == [("c", "b", 2), ("d", None, 3), ("f", "e", 3)]


def test_mmr_without_diversity_is_top_k():
    rng = random.Random(1)
    rows = [{"id": i, "file": f"f{i % 3}", "start": i, "end": i + 3, "code": " ".join(rng.choices("alpha beta gamma delta".split(), k=5)), "score": rng.random()} for i in range(30)]
    top = sorted(range(30), key=lambda i: -rows[i]["score"])[:7]
    assert SIM.mmr(rows, 7, 1.0) == top
    assert len(set(SIM.mmr(rows, 7, 0.0))) == 7 and SIM.mmr([], 3, 0.5) == []


def test_path_similarity(spark):
    cases = {("a/x", "a/x"): 1.0, ("a/x", "a/y"): 0.7, ("a/b/x", "a/c/y"): 0.3 + 1 / 3 * 0.3, ("x", "y"): 0.0}
    df = spark.createDataFrame(list(cases), "a string, b string").select("a", "b", SIM.path_similarity(F.col("a"), F.col("b")).alias("s"))
    assert {(r.a, r.b): round(r.s, 9) for r in df.collect()} == {k: round(v, 9) for k, v in cases.items()}


def test_cycles_are_simple_and_complete(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(8), rng.randrange(8)) for _ in range(20)}
    got = {tuple(r.cycle) for r in G.cycles(spark.createDataFrame(sorted(edges), "src long, dst long"), 4).collect()}
    want = {p for n in range(2, 5) for p in itertools.permutations(range(8), n) if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in edges for i in range(n))}
    assert got == want


def test_change_set_apply_equals_rebuild(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changes = spark.createDataFrame([(2, "x", "M", 1), (2, "y", "M", 2), (3, None, "D", 3), (4, "n", "A", 4)], "k long, v string, change string, seq long")
    once = ST.apply_changes(base, changes, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (4, "n")]
    assert sorted(map(tuple, ST.apply_changes(once, changes, ["k"]).collect())) == [(1, "a"), (2, "y"), (4, "n")]


def test_token_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id long, cost long")
    assert [r.id for r in W.token_budget(df, F.col("cost"), [F.col("id")], 7).collect()] == [1]


def test_boost_first_symbol_decides(spark):
    df = spark.createDataFrame([("getUser", ["user", "getUser"]), ("getUser", ["getUser"]), ("x", [])], "q string, s array<string>")
    assert [round(r.b, 6) for r in df.select(S.symbol_boost(F.col("q"), F.col("s")).alias("b")).collect()] == [2.1, 3.0, 1.0]


def test_approximate_neighbours_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows, centres = S.ivf_index(e, "vec_id", "embedding", lists=10)
    near = {(r.query_id, r.vec_id) for r in S.ivf_search(rows, centres, q, "vec_id", "embedding", 10, probes=8).collect()}
    exact = {(r.query_id, r.vec_id) for r in S.top_k(S.vector_scores(e, q, "vec_id", "embedding"), 10, key="vec_id").collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_stored_lists_give_the_same_neighbours(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    S.VectorIndex.write(e, "vec_id", "embedding", str(tmp_path / "v"), 6)
    index = S.VectorIndex(spark, str(tmp_path / "v"), "vec_id", "embedding")
    all_lists = {(r.query_id, r.vec_id) for r in index.search(q, 10, probes=6).collect()}
    exact = {(r.query_id, r.vec_id) for r in S.top_k(S.vector_scores(e, q, "vec_id", "embedding"), 10, key="vec_id").collect()}
    assert all_lists == exact and index.rows.count() == e.count()
    one = index.search(q.limit(1), 5, probes=1)
    assert "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString() or "PartitionFilters: [list" in one._jdf.queryExecution().toString()


def test_suppressed_blocks(spark):
    review = "**[SEVERITY: HIGH]** one\nFile: a.ts:2\n\n**[SEVERITY: LOW]** two\nFile: a.ts:9\n\nIssues Summary: 0 CRITICAL, 1 HIGH, 0 MEDIUM, 1 LOW"
    reviews = spark.createDataFrame([(1, review), (2, None), (3, "")], "id long, review string")
    files = spark.createDataFrame([("a.ts", "x // review: ignore\ny"), ("b.ts", None)], "file string, content string")
    got = {r.id: (r.review, r.n_suppressed) for r in FN.drop_suppressed_blocks(reviews, "review", "id", files).collect()}
    assert got[1][1] == 1 and "one" not in got[1][0] and "two" in got[1][0] and "Issues Summary: 0 CRITICAL, 0 HIGH, 0 MEDIUM, 1 LOW" in got[1][0]
    assert got[2] == (None, 0) and got[3] == ("", 0)


def test_source_files_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "node_modules/c.js").write_text("no")
    got = FS.source_files(spark, str(tmp_path)).collect()
    assert [(r.file, r.content, r.language) for r in got] == [("src/a.py", "x = 1", "python")]
    log = tmp_path / "log"
    log.write_text("s1\x1fann\x1f2024\x1ffirst\x1e\ns2\x1fbob\x1f2025\x1fsecond\x1e")
    assert [(r.sha, r.subject) for r in FS.commit_log(spark, str(log)).collect()] == [("s1", "first"), ("s2", "second")]
    (tmp_path / "recs").mkdir()
    (tmp_path / "recs/1.json").write_text('{"id": "a",\n "n": 1}')
    (tmp_path / "recs/2.json").write_text("{broken")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    assert [r.id for r in FS.json_records(spark, str(tmp_path / "recs"), StructType([StructField("id", StringType()), StructField("n", LongType())])).collect()] == ["a"]
    FS.append_jsonl(spark.range(2), str(tmp_path / "out"))
    FS.append_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_glob_patterns(spark):
    df = spark.createDataFrame([("src/a/b.ts",), ("b.ts",), ("src/x.min.js",), ("dist/b.ts",)], "p string")
    kept = df.where(FS.matches_globs(F.col("p"), ["**/*.ts", "src/*.js"], ["dist/**", "**/*.min.js"])).collect()
    assert [r.p for r in kept] == ["src/a/b.ts", "b.ts"]


def test_poll_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "h1", False, True), ("a", 2, "h1", False, False), ("a", 3, "h2", False, True), ("a", 4, "h3", True, False), ("a", 5, "h4", False, False), ("b", 6, "g", False, False)]
    schema = "key string, seq long, head string, failed boolean, findings boolean"
    df = spark.createDataFrame(rows, schema)
    batch = {(r.key, r.seq): r.decision for r in ST.poll_decisions(df, "key", "head", ["seq"], F.col("failed"), F.col("findings")).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    q = ST.poll_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", str(tmp_path / "cp"), lambda d, _: got.update({(r.key, r.seq): r.decision for r in d.collect()}))
    q.awaitTermination()
    assert got == batch


def test_change_stream_merges(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    schema = "k long, v string, change string, seq long"
    spark.createDataFrame([(2, None, "D", 1), (3, "c", "A", 2)], schema).write.parquet(str(tmp_path / "in"))

    def merge(batch, _):
        ST.apply_changes(base, batch, ["k"]).write.mode("overwrite").parquet(path)

    ST.stream_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), merge, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (3, "c")]


def test_cache_embeds_each_miss_once(spark):
    cache = spark.createDataFrame([("0", "m", [1.0], 5, 1)], "content_hash string, model_name string, embedding array<double>, last_used_at long, hit_count long").withColumn("content_hash", F.sha2(F.lit("x"), 256))
    rows = spark.createDataFrame([("x",), ("y",), ("y",)], "text string")
    out = S.cache_store(cache, S.cache_lookup(rows, cache, "text", "m"), "m", lambda d: d.withColumn("embedding", F.array(F.lit(2.0))), F.lit(9).cast("long")).collect()
    assert sorted((r.embedding[0], r.hit_count, r.last_used_at) for r in out) == [(1.0, 2, 9), (2.0, 0, 9)]


def test_windowed_counts_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = ST.windowed_counts(spark.readStream.schema(e.schema).parquet("/root/testdata/sf0.001/events.parquet*"), "ts", "event_type")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, ST.windowed_counts(e, "ts", "event_type").collect()))


def test_strategies_by_file_type(spark):
    from textquarry.operators import retrieval as RT

    rows = [("src/a.ts", "class A extends Base<T> implements Shape, Other {}"), ("a/b/c.py", "def f(): pass"), ("x.vue", "class A extends Base"), (None, None)]
    df = spark.createDataFrame(rows, "p string, c string").withColumn("k", RT.file_type(F.col("p"), {".vue": "typescript"}))
    got = df.select("k", RT.priority_queries(F.col("k"), F.col("c")).alias("q"), RT.related_paths(F.col("p"), F.col("k")).alias("r"), RT.strategy_weight(F.col("k"), {"python": 3.0}).alias("w")).collect()
    assert [(x.query, x.weight) for x in got[0].q] == [("class Base", 1.6), ("interface Shape, Other", 1.6), ("type T", 1.3)]
    assert got[1].r[-3:] == ["a/b/conftest.py", "a/conftest.py", "conftest.py"] and [r.w for r in got] == [1.5, 3.0, 1.5, 1.0] and got[2].k == "typescript"
    off = df.select(RT.file_type(F.col("p"), disabled=("typescript",)).alias("k")).collect()
    assert [r.k for r in off] == ["generic", "python", "generic", "generic"]


def test_relations_keep_the_literal_rule(spark):
    from textquarry.operators import retrieval as RT

    rows = [(1, "call foo( and foo.bar", ["one"], ["foo"], []), (2, "text", ["foo"], [], []), (3, "only foo(", ["three"], [], [])]
    c = spark.createDataFrame(rows, "id long, content string, symbols array<string>, imports array<string>, exports array<string>")
    assert sorted(map(tuple, RT.relations(c).collect())) == [(1, 2, "imports"), (1, 2, "references"), (3, 2, "references")]
    assert sorted(map(tuple, RT.relations(c, strict=True).collect())) == [(1, 2, "imports"), (3, 2, "references")]


def test_queries_of_a_diff():
    diff = "diff --git a/src/db.ts b/src/db.ts\nindex 1..2\n--- a/src/db.ts\n+++ b/src/db.ts\n@@ -1,3 +1,4 @@\n+import { Pool, Client as Db } from './lib/pool'\n-function oldName(x) {\n+async function connect(url: string): Promise<Session> {\n keep(this)\n+emit('ready')"
    queries = D.queries_of_diff(diff)
    assert {"Pool", "oldName", "connect", "Session", "ready", "lib pool"} <= set(queries) and "keep" not in queries
    names = [q for q in queries if q.isidentifier()]
    assert queries[: len(names)] == names and [len(n) for n in names] == sorted(map(len, names)) and len(queries) <= 15
    assert D.symbols_of_diff(diff) == ["Pool", "Client", "./lib/pool", "oldName", "connect"]
    assert len(D.symbols_of_diff("\n".join(f"+def name{i}(x)" for i in range(40)))) == 20
    assert D.queries_of_diff(None) == D.queries_of_diff("") == D.symbols_of_diff(None) == []
    assert len(D.queries_of_diff("\n".join(f"+function name{i}(x) {{" for i in range(40)))) == 15


def test_line_queries_by_group():
    assert D.line_queries("public static int total(List<Item> xs) {")[:1] == ["total"]
    assert "UserStore" in D.line_queries("class A implements UserStore, Other {") and "Other" in D.line_queries("class A implements UserStore, Other {")
    assert {"os", "path"} & set(D.line_queries("from os.path import join, split as cut")) == set() and {"join", "cut"} <= set(D.line_queries("from os.path import join, split as cut"))
    assert "users" in D.line_queries("get('/api/users')") and "USER_LOGGED_IN" in D.line_queries("x('USER_LOGGED_IN')")
    assert D.line_queries("if (x) return null") == D.line_queries("") == []


def test_description(spark):
    text = "# Fix\n\nThe UserService in `src/user.ts` reads http_retry twice, see lib/db/pool.py."
    row = spark.createDataFrame([(text,), (" ",), (None,)], "t string").select(D.description_parts(F.col("t")).alias("p")).withColumn("q", D.description_queries(F.col("p"))).collect()
    assert "src/user.ts" in row[0].p.paths and row[0].p.concepts[:2] == ["UserService", "http_retry"] and row[0].p.summary.startswith("The UserService")
    assert row[0].q[:2] == ["src/user.ts", "user"] and len(row[0].q) <= 8 and row[1].p is None and row[2].p is None


def test_review_parts():
    text = "### Summary\nFine.\n\n**[HIGH]** - Bug: Bad loop\nFile: `x.py:4`\n\n```py\ncode\n```\n\n## Positive Observations\nno bullets but long lines\n"
    got = FN.review_of(text)
    assert got["summary"] == "Fine." and [(i["severity"], i["title"], i["file"], i["line"]) for i in got["issues"]] == [("HIGH", "Bad loop", "x.py", 4)]
    assert got["positives"] == ["no bullets but long lines"] and got["recommendation"] == "NEEDS_DISCUSSION"
    assert FN.review_of(None) is FN.review_of("") is FN.review_of("short") is None
    assert FN.review_of("Verdict: approve")["merge"] == "SAFE_TO_MERGE"


def test_call_targets(spark):
    symbols = spark.createDataFrame([(1, "a", "run", 5), (2, "b", "run", 1), (3, "c", "run", 2), (3, "c", "Job", 1), (4, "a", "stop", 9), (4, "a", "stop", 9), (5, "d", "print", 1)], "id long, file string, symbol string, line int")
    calls = [(4, "a", "run", None, False, False), (2, "b", "run", None, False, False), (1, "a", "stop", "self", True, False), (2, "b", "stop", "this", True, False), (2, "b", "run", "Job", True, False), (4, "a", "print", None, False, False), (4, "a", "stop", "x", True, True), (5, "d", "run", "<call_result>", True, False), (None, None, None, None, None, None)]
    df = spark.createDataFrame(calls, "src long, file string, callee string, receiver string, is_method boolean, is_dynamic boolean")
    assert sorted(map(tuple, G.resolve_calls(df, symbols).collect())) == [(1, 4, "stop"), (2, 3, "run"), (4, 1, "run")]
    assert G.resolve_calls(df, symbols, frozenset()).where("callee = 'print'").count() == 1 and G.resolve_calls(df.limit(0), symbols).count() == 0
    assert {"len", "append", "print", "console"} <= G.builtin_names()


def test_importers(spark):
    rows = [("b.ts", "import x from './a'"), ("c.ts", "const a = require(\"../a.js\")"), ("d.py", "from pkg.a import y"), ("e.ts", "from './ab'"), ("keys/f.pem", "from './a'"), ("src/a.ts", "from './a'"), ("g.ts", None)]
    got = S.importers_by_text(spark.createDataFrame(rows, "file string, content string"), "src/a.ts").first()
    assert got.importers == ["b.ts", "c.ts", "d.py"] and (got.n, got.high_impact, got.partial) == (3, False, True)


def test_bounded_cache_equals_a_played_one(spark):
    from collections import OrderedDict

    rng = random.Random(4)
    rows = [(f"c{rng.randrange(2)}", i, rng.randrange(14), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(600)]
    df = spark.createDataFrame(rows, "cache string, n long, key long, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.n: r.hit for r in ST.lru_hits(df, "cache", "key", ["n"], "at", 6, 40).collect()}
    held, want = {"c0": OrderedDict(), "c1": OrderedDict()}, {}
    for cache, n, key, _ in rows:
        own = held[cache]
        if want.setdefault(n, key in own and n <= own[key] + 40):
            own.move_to_end(key)
        else:
            own.pop(key, None)
            own[key] = n
            if len(own) > 6:
                own.popitem(last=False)
    assert got == want and 0 < sum(got.values()) < len(got) and ST.lru_hits(df.limit(0), "cache", "key", ["n"], "at").count() == 0


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, f"g{i % 3}", rng.sample([f"t{j}" for j in range(25)], rng.randrange(0, 12))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g string, ts array<string>")
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r.g, r.a, r.b): round(r.jaccard, 9) for r in SIM.similar_pairs(df, "g", "id", F.col("ts"), least).collect()}
        want = {(g, a, b): round(len(set(x) & set(y)) / len(set(x) | set(y)), 9) for (a, g, x), (b, h, y) in itertools.combinations(rows, 2) if g == h and x and y}
        assert got == {k: v for k, v in want.items() if v >= least - 1e-9}


def test_stored_index_prunes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alpha beta alpha"), (2, "beta"), (3, None), (4, ""), (4, "alphaBeta")], "id long, text string")
    S.Index.write(docs, "id", "text", str(tmp_path / "i"), buckets=4)
    index = S.Index(spark, str(tmp_path / "i"), "id")
    asked = spark.createDataFrame([(1, ["alpha"]), (2, ["none"])], "query_id int, terms array<string>")
    assert {(r.query_id, r.id) for r in S.index_scores(index, asked).collect()} == {(1, 1), (1, 4)} and index.n == 5
    plan = index.of(spark.createDataFrame([("alpha",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(term,alpha)" in plan or "In(term" in plan
    many = index.of(spark.createDataFrame([("alpha",), ("beta",)], "term string"), most=1)
    assert {(r.id, r.term, r.tf) for r in many.collect()} == {(1, "alpha", 2), (1, "beta", 1), (2, "beta", 1), (4, "alpha", 1), (4, "beta", 1)}
    S.Index.write(docs.limit(0), "id", "text", str(tmp_path / "e"))
    assert S.index_scores(S.Index(spark, str(tmp_path / "e"), "id"), asked).count() == 0


def test_vector_blocks_give_the_same(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    q = e.where("vec_id < 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one, blocks = ({(r.query_id, r.vec_id): round(r.score, 9) for r in S.vector_scores(e, q, "vec_id", "embedding", most).collect()} for most in (2000, 5))
    assert one == blocks and len(one) == 12 * e.count()


def test_operators_on_nulls_ties_and_empty_tables(spark):
    rows = [(1, "f", 2.0), (2, "f", 2.0), (2, "f", 2.0), (3, None, None), (None, "f", 1.0)]
    df = spark.createDataFrame(rows, "id long, file string, score double")
    assert [(r.id, r.rank, r.removed) for r in W.top_per_group(df.where("file = 'f'"), "file", "score", "id", 2, removed=True).orderBy("rank").collect()] == [(1, 1, 2), (2, 2, 2)]
    assert W.top_per_group(df.limit(0), "file", "score", "id", 2).count() == 0
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (None, 2), (2, None)], "src long, dst long")
    assert [(r.node, r.n) for r in G.hubs(edges.where("src is not null"), 2, 5).collect()] == [(2, 2)]
    assert G.cycles(edges.limit(0)).count() == 0 and G.neighbourhood(edges.limit(0)).count() == 0 and G.bfs(edges.limit(0), spark.createDataFrame([(1,)], "root long"), 2).collect()[0].depth == 0
    assert G.collapse_calls(spark.createDataFrame([(1, 2, "a"), (1, 2, "b")], "src long, dst long, callee string")).first().callee == "b"
    reviews = spark.createDataFrame([(1, None), (2, "")], "id long, review string")
    assert {r.outcome for r in FN.parse_findings(reviews, "review").collect()} == {"missing"} and FN.parse_findings(reviews.limit(0), "review").count() == 0
    lines = D.changed_lines(reviews, "id", "review")
    assert lines.count() == 0 and D.lines_by_change(lines, "id").count() == 0


def test_tree_lines_order(spark):
    rows = [("a/z.ts", False), ("a/b/c.ts", False), ("a/b/a.ts", True), ("d.ts", False), ("c/x.ts", False), ("a/b/c/d/e/f.ts", False)]
    got = C.tree_lines(spark.createDataFrame(rows, "p string, m boolean"), "p", "m", most=9).collect()
    assert [r.node for r in got] == ["a", "a/b", "a/b/a.ts", "a/b/c", "a/b/c/d", "a/b/c.ts", "a/z.ts", "c", "c/x.ts"] and [r.position for r in got] == list(range(1, 10))


def test_grep_column_of_a_match_at_the_start(spark):
    docs = spark.createDataFrame([(1, "token\na token\n\rtoken'd"), (2, None), (3, "tokentoken")], "k long, text string")
    assert [(r.k, r.line_no, r.column) for r in S.grep(docs, "k", "text", "token", fixed=True).collect()] == [(1, 1, 1), (1, 2, 3), (1, 3, 2), (3, 1, 1)]
    assert [(r.line_no, r.column) for r in S.grep(docs, "k", "text", r"^\w|n'", word=False).collect()] == [(1, 1), (2, 1), (3, 6), (1, 1)]


def test_grep_gives_all_lines_unless_a_limit_is_given(spark):
    docs = spark.range(40).selectExpr("id as k", "repeat('a token\\n', 60) as text")
    got = [(r.k, r.line_no) for r in S.grep(docs, "k", "text", "token", fixed=True).collect()]
    assert got == [(k, i) for k in range(40) for i in range(1, 61)]
    assert S.grep(docs, "k", "text", "token", 1500).count() == 1500 and S.grep(docs, "k", "text", "token", 7).count() == 7


def test_neighbours_of_one_group_are_dealt_out(spark):
    rows = [(None if i % 50 == 0 else "g" if i % 10 else "h", i, i * i % 17) for i in range(3000)]
    want, last = {}, {}
    for g, i, x in rows:
        want[i] = None if g not in last else 1000 * last[g] + 3 * x
        last[g] = 3 * x
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, i int, x int").repartition(5)
        out = W.similarity_to_previous(df, "g", F.col("i"), lambda a, b: 1000 * a["x"] + b["x"], {"x": 3 * F.col("x")})
        parts = out.select("i", "x", "similarity", F.spark_partition_id().alias("p")).collect()
        back = W.similarity_to_previous(df, "g", [F.desc("i")], lambda a, b: a["i"] - b["i"]).where("similarity is not null").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.i: r.similarity for r in parts} == want and all(r.x == 3 * (r.i * r.i % 17) for r in parts)
    assert max(sum(r.p == p for r in parts) for p in {r.p for r in parts}) < 2000  # g has 2,700 rows
    assert len(back) == 2997 and all(r.similarity > 0 for r in back)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_import_edges_broadcast_no_paths(spark):
    known = spark.range(50).select(F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("file"))
    files = known.select("file", F.array(F.lit("./f1")).alias("imports"))
    edges = G.import_edges(files, known)
    assert "BroadcastHashJoin" not in plan_of(edges) and edges.count() == 49


def test_test_chunks_broadcast_no_paths(spark):
    sources = spark.range(20).select(F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit(".ts")).alias("file"))
    chunks = spark.range(60).select("id", F.concat(F.lit("src/m"), (F.col("id") % 10).cast("string"), F.lit(".test.ts")).alias("file"), F.col("id").alias("start"), F.lit(1.0).alias("score"))
    got = D.test_chunks(sources, chunks)
    assert "BroadcastHashJoin" not in plan_of(got) and got.count() == 30


def test_reports_are_put_together_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(FS, "PIECE_LINES", 7)
    rows = [(i % 2, ["HIGH", "LOW", None][i % 3], f"t{i % 5}", "a.ts", i) for i in range(100)] + [(9, None, "t", "a.ts", 1)]
    df = spark.createDataFrame(rows, "feature_id int, severity string, title string, file string, line int")
    got = {r.feature_id: r.body for r in FS.report_lines(df, "text").collect()}
    rank = {"HIGH": 1, "LOW": 3}
    for k in (0, 1):
        mine = sorted((r for r in rows if r[0] == k and r[1]), key=lambda r: (rank[r[1]], *r[2:]))
        assert got[k] == "\n".join(f"[{s}] {t} ({f}:{n})" for _, s, t, f, n in mine)
    assert got[9] == "" and len(got) == 3


def test_phrase_votes_are_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a b b a"), (2, "b a"), (3, "a a a b"), (4, None)], "doc_id long, text string")
    S.Index.write(docs, "doc_id", "text", f"{tmp_path}/i")
    phrases = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"]), (3, ["b", "a", "b"]), (4, ["b"])], "phrase_id int, words array<string>")
    found = S.phrase_matches(S.Index(spark, f"{tmp_path}/i", "doc_id"), phrases)
    assert {(r.phrase_id, r.doc_id): r.n for r in found.collect()} == {(1, 1): 2, (1, 3): 1, (2, 3): 2, (3, 1): 1, (4, 1): 3, (4, 2): 1, (4, 3): 1}
    assert dict(found.dtypes)["n"] == "bigint" and "Generate explode(positions" not in plan_of(found)
