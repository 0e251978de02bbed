"""Queries of the graph, retrieval, chunk, function and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import text as X
from textquarry.operators import chunking as C
from textquarry.operators import diffs as D
from textquarry.operators import findings as FN
from textquarry.operators import graph as G
from textquarry.operators import retrieval as RT
from textquarry.operators import similarity as SIM
from textquarry.plans.registry import expected, expected_rows, long, number, pick, query, sql_pick
from textquarry.plans.shared import SQL_CHUNKS, SQL_WORDS, located, sql_likeness
from textquarry.storage import fresh_dir
from textquarry.streaming import keyed as KS
from textquarry.streaming import state as ST


def order_edges(t):
    return t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("""with e as (select distinct l_orderkey as src, l_partkey as dst from lineitem), h as (select dst, count(*) as n from e group by dst having count(*) >= 10 order by n desc, dst limit 25),
r as (select e.dst, n, src, row_number() over (partition by e.dst order by src) as r from e join h using (dst)) select dst as node, n, string_agg(cast(src as varchar), ',' order by src) as importers from r where r <= 10 group by all""")
def hub_nodes(spark, t):
    """A3 GR4: hubs with their first ten sources."""
    h = G.hubs(order_edges(t), 10, 25)
    return h.select("node", "n", F.array_join(F.transform("importers", lambda x: x.cast("string")), ",").alias("importers"))


USER_EDGES = "(select distinct user_id as src, nxt as dst from (select user_id, lead(user_id) over (partition by event_type order by ts, event_id) as nxt from events) where nxt is not null and nxt <> user_id)"


def user_edges(t):
    e = t("events").withColumn("nxt", F.expr("lead(user_id) over (partition by event_type order by ts, event_id)"))
    return e.where("nxt is not null and nxt <> user_id").select(F.col("user_id").alias("src"), F.col("nxt").alias("dst")).distinct()


@query(f"""with e as (select * from {USER_EDGES}), n as (select src as root from e union select dst from e),
o1 as (select distinct src as root, dst as x from e), o2 as (select a.root, b.dst as x from o1 a join e b on a.x = b.src where a.root <> b.dst except select root, x from o1),
i1 as (select distinct dst as root, src as x from e), i2 as (select a.root, b.src as x from i1 a join e b on a.x = b.dst where a.root <> b.src except select root, x from i1),
g as (select root, 'o1' as k, string_agg(cast(x as varchar), ',' order by x) as xs, count(*) as c from o1 group by 1 union all select root, 'o2', string_agg(cast(x as varchar), ',' order by x), count(*) from o2 group by 1
union all select root, 'i1', string_agg(cast(x as varchar), ',' order by x), count(*) from i1 group by 1 union all select root, 'i2', string_agg(cast(x as varchar), ',' order by x), count(*) from i2 group by 1)
select n.root, max(xs) filter (k = 'o1') as direct_out, max(xs) filter (k = 'i1') as direct_in, max(xs) filter (k = 'o2') as indirect_out, max(xs) filter (k = 'i2') as indirect_in, cast(coalesce(sum(c) filter (k in ('i1', 'i2')), 0) as integer) as dependents from n left join g using (root) group by n.root""")
def two_hop(spark, t):
    """GR2 GR12 O3: both directions and two hops, all roots in one plan."""
    tree = G.neighbourhood(user_edges(t)).withColumn("dependents", G.dependents_of("direct_in", "indirect_in"))
    return tree.select("root", *[F.nullif(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c) for c in ("direct_out", "direct_in", "indirect_out", "indirect_in")], "dependents")


NATION_EDGES = "(select n_nationkey as src, (n_nationkey * 7 + 3) % 25 as dst from nation union select n_nationkey, (n_nationkey + 1) % 25 from nation where n_nationkey % 3 = 0 union select n_nationkey, (n_nationkey + 24) % 25 from nation where n_nationkey % 4 = 1)"


def nation_edges(t):
    n = t("nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("src"), ((k * 7 + 3) % 25).alias("dst")).union(n.where(k % 3 == 0).select(k, (k + 1) % 25)).union(n.where(k % 4 == 1).select(k, (k + 24) % 25)).distinct()


@query(f"""with recursive e as (select * from {NATION_EDGES} where src <> dst), p as (select src as start, dst as last, [src, dst] as path from e where src < dst
union all select start, e.dst, list_append(path, e.dst) from p join e on p.last = e.src where e.dst > start and not list_contains(path, e.dst) and len(path) < 6)
select array_to_string(path, '>') as cycle, case when len(path) = 2 then 'direct' else 'indirect' end as cycle_type from p join e on p.last = e.src and p.start = e.dst""")
def cycles(spark, t):
    """GR3: simple cycles of up to six nodes."""
    return G.cycles(nation_edges(t)).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "cycle_type")


@query("""with recursive e as (select p_partkey as src, p_partkey - p_partkey % 10 + (p_partkey * 3 + p_size) % 10 as dst from part union select p_partkey, p_partkey + 10 from part where p_partkey % 10 = p_size % 10 and p_partkey % 50 < 40),
r(a, b) as (select src, dst from e where src <> dst union select r.a, e.dst from r join e on r.b = e.src where e.src <> e.dst)
select x.a as node, max(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a""")
def strong_components(spark, t):
    """GR3 GR11: strongly connected components of files, with much that no cycle uses."""
    k, size = F.col("p_partkey"), F.col("p_size")
    inside = t("part").select(k.alias("src"), (k - k % 10 + (k * 3 + size) % 10).alias("dst"))
    return G.components(inside.union(t("part").where((k % 10 == size % 10) & (k % 50 < 40)).select(k, k + 10)))


@query(f"""with recursive e as (select * from {NATION_EDGES}), b(root, node, depth) as (select n_nationkey, n_nationkey, 0 from nation where n_nationkey < 5 union select root, e.dst, depth + 1 from b join e on b.node = e.src where depth < 4)
select root, node, cast(min(depth) as integer) as depth from b group by root, node""")
def bfs_depth(spark, t):
    """GR8: least depths within four steps."""
    return G.bfs(nation_edges(t), t("nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("root")), 4)


@query(f"""with recursive e as (select * from {NATION_EDGES}), b(root, node, depth) as (select n_nationkey, n_nationkey, 0 from nation where n_nationkey < 3 union select root, e.src, depth + 1 from b join e on b.node = e.dst where depth < 3),
m as (select root, node, cast(min(depth) as integer) as depth from b group by root, node) select root, node, depth from m qualify row_number() over (partition by root order by depth, node) <= 6""")
def bfs_callers(spark, t):
    """GR8: callers, capped."""
    return G.bfs(nation_edges(t), t("nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("root")), 3, "callers", 6)


@query("""select s_suppkey as node, s_suppkey in (select l_orderkey from lineitem) as is_caller, s_suppkey in (select l_partkey from lineitem) as is_callee from supplier""")
def endpoint_roles(spark, t):
    """GR9."""
    return G.endpoint_roles(order_edges(t), t("supplier").select(F.col("s_suppkey").alias("node")))


@query(f"""with recursive ne as (select * from {NATION_EDGES} where src <> dst), p as (select src as start, dst as last, [src, dst] as path from ne where src < dst
union all select start, ne.dst, list_append(path, ne.dst) from p join ne on p.last = ne.src where ne.dst > start and not list_contains(path, ne.dst) and len(path) < 6),
cyc as (select path from p join ne on p.last = ne.src and p.start = ne.dst), m as (select unnest(path) as file, len(path) as n from cyc), c as (select p_partkey as file from part where p_partkey % 5 = 0),
e as (select distinct l_orderkey as src, l_partkey as dst from lineitem), i as (select dst as file, count(*) as n from e where dst in (select file from c) group by dst)
select file, 'high_impact_change' as warning, case when n >= 10 then 'high' else 'medium' end as severity, n from i where n >= 5
union all select file, 'hub_file', case when n >= 20 then 'critical' else 'high' end, n from i where n >= 10
union all select file, 'circular_dependency', case when min(n) = 2 then 'high' else 'medium' end, min(n) from m where file in (select file from c) group by file""")
def impact_warnings(spark, t):
    """GR11 L5: warnings for changed nodes: importers, hubs, and the shortest cycle through each."""
    changed = t("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("file"))
    return G.impact_warnings(changed, order_edges(t), G.cycles(nation_edges(t)))


@query("""with s as (select p_partkey as id, unnest(string_split(p_name, ' ')) as symbol, p_brand as file, p_size as line from part),
c as (select p_partkey as src, p_brand as file, string_split(p_name, ' ')[1] as callee, string_split(p_name, ' ')[2] as receiver, p_partkey % 5 as k from part where p_partkey % 5 < 3 and string_split(p_name, ' ')[1] <> 'hot'),
r as (select src, callee, s.id as dst, case when k = 2 then case when exists (select 1 from s b where b.id = s.id and b.symbol = c.receiver) then 0 else 1 end when c.file = s.file then 0 else 1 end as p, s.line, s.file, k, c.file as own from c join s on c.callee = s.symbol where src <> s.id),
o as (select *, row_number() over (partition by src order by p, line, file, dst) as n from r where k <> 1 or file = own) select src, dst, callee from o where n = 1""")
def call_resolution(spark, t):
    """GR7 J13: plain calls, methods of the own class and of a named receiver; dynamic, unknown and built-in ones resolve to nothing."""
    p = t("part")
    words, k = F.split("p_name", " "), F.col("p_partkey") % 5
    s = p.select(F.col("p_partkey").alias("id"), F.explode(words).alias("symbol"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"))
    receiver = F.when(k == 1, "this").when(k == 2, F.get(words, F.lit(1))).when(k == 4, "<call_result>")
    calls = p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("file"), F.get(words, F.lit(0)).alias("callee"), receiver.alias("receiver"), (k > 0).alias("is_method"), (k == 3).alias("is_dynamic"))
    return G.resolve_calls(calls, s, frozenset(("hot",)))


@query("""with l as (select distinct l_orderkey as src, l_partkey as dst, l_returnflag as callee from lineitem) select src, dst, max(callee) as callee from l group by src, dst""")
def collapsed_calls(spark, t):
    """GR7: one stored edge per pair."""
    return G.collapse_calls(t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("callee")))


@query("""with s as (select item_id as id, list_extract(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 3) as token from benchmark), d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) as token from documents)
select distinct doc_id as src, id + 1000000 as dst from d join s using (token)""")
def reference_edges(spark, t):
    """J10 GR10: token references as an equi-join."""
    s = t("benchmark").select((F.col("item_id") + 1_000_000).alias("id"), F.get(F.regexp_extract_all(F.lower("text"), F.lit(X.TOKEN), F.lit(0)), F.lit(2)).alias("symbol"))
    return G.reference_edges(t("documents"), s, "doc_id", "text")


@query("""with r as (select doc_id as s, doc_id + 1 as d from documents) select s as src, d as dst from r where s not in (select doc_id from labels) or d not in (select doc_id from labels)""")
def orphans(spark, t):
    """Edges without one of their ends."""
    e = t("documents").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return G.orphans(e, t("labels").select(F.col("doc_id").alias("id")))


@query("""with f as (select distinct source from documents where source in ('src1', 'src2')), k as (select doc_id from documents where source not in (select source from f))
select (select count(distinct source) from documents where source not in (select source from f)) as files, (select count(*) from k) as chunks,
(select count(*) from documents where doc_id in (select doc_id from k) and (doc_id + 1 in (select doc_id from k) or doc_id + 1 not in (select doc_id from documents))) as relations""")
def cascade_delete(spark, t):
    """GR13: files, their chunks and what touches them."""
    d = t("documents")
    files = d.select(F.col("source").alias("file")).distinct()
    chunks = d.select(F.col("doc_id").alias("id"), F.col("source").alias("file"))
    relations = d.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    imports = files.select(F.col("file").alias("source_file"), F.col("file").alias("target_file"))
    out = G.cascade_delete(files, chunks, relations, imports, F.col("file").isin("src1", "src2"))
    n = {k: v.agg(F.count("*").alias(k)) for k, v in out.items()}
    return n["files"].crossJoin(n["chunks"]).crossJoin(n["relations"])  # one row each


IMPORTS = ("./a", "../src/b", "react", "./missing", "./dir")


IMPORTED = ("./f{n}", "../src/f{n}", "react", "./dir{n}", "./missing", "src/f{n}.ts")
SQL_IMPORTED = "case i when 0 then './f' || n when 1 then '../src/f' || n when 2 then 'react' when 3 then './dir' || n when 4 then './missing' else 'src/f' || n || '.ts' end"


@query(f"""with k as (select p_partkey as k, 'src/f' || p_partkey || case p_partkey % 3 when 0 then '.ts' when 1 then '.py' else '/index.ts' end as file from part union all select p_partkey, 'src/dir' || p_partkey || '/__init__.py' from part where p_partkey % 2 = 0),
s as (select 'src/f' || p_partkey || case p_partkey % 3 when 0 then '.ts' when 1 then '.py' else '/index.ts' end as source_file, p_partkey % 3 as kind, i, (p_partkey + 1 + i) % (select count(*) from part) as n, case when p_partkey % 3 = 2 then 'src/f' || p_partkey else 'src' end as folder from part, range(6) r(i)),
b as (select source_file, i, {SQL_IMPORTED} as spec, case when i in (0, 3, 4) then folder || '/' || ({SQL_IMPORTED})[3:] when i = 1 then case when kind = 2 then 'src/src/f' || n else 'src/f' || n end else {SQL_IMPORTED} end as base from s),
c as (select source_file, spec, base || e as target_file, p from b, (values ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.py', 5), ('/index.ts', 6), ('/index.js', 7), ('/__init__.py', 8)) x(e, p)),
f as (select source_file, spec, arg_min(target_file, p) as target_file from c where target_file in (select file from k) group by all) select distinct source_file, target_file, 'static' as import_type from f where source_file <> target_file""")
def import_resolution(spark, t):
    """GR1 J12: specifiers to the first file that exists."""
    p = t("part")
    k, n = F.col("p_partkey"), p.count()
    ending = F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".py").otherwise("/index.ts")
    own = F.concat(F.lit("src/f"), k.cast("string"), ending)
    specs = [F.concat(F.lit(a), F.when(F.lit("{n}" in x), F.pmod(k + 1 + i, F.lit(n)).cast("string")).otherwise(""), F.lit(b)) for i, x in enumerate(IMPORTED) for a, _, b in [x.partition("{n}")]]
    files = p.select(own.alias("file"), F.array(*specs).alias("imports"))
    known = files.select("file").unionByName(p.where(k % 2 == 0).select(F.concat(F.lit("src/dir"), k.cast("string"), F.lit("/__init__.py")).alias("file")))
    return G.import_edges(files, known)


@query(f"""with t as (select doc_id, source, {SQL_WORDS} as ts from documents where text is not null), p as (select a.source, a.doc_id as a, b.doc_id as b, len(list_intersect(a.ts, b.ts)) as s, len(a.ts) as n, len(b.ts) as m from t a join t b on a.source = b.source and a.doc_id < b.doc_id)
select source, a, b, round(s / (n + m - s), 6) as jaccard from p where n > 0 and m > 0 and s / (n + m - s) >= 0.7 - 1e-9""")
def jaccard_pairs(spark, t):
    """Pairs of a file's chunks with seven tenths of their words in common, over whole texts."""
    return SIM.similar_pairs(t("documents"), "source", "doc_id", SIM.similarity_tokens(F.col("text")), 0.7).select("source", "a", "b", number("jaccard").alias("jaccard"))


@query(f"with c as {SQL_CHUNKS}, p as (select *, lead(doc_id) over (partition by lang order by doc_id) as other from c) select p.doc_id as a, d.doc_id as b, round({sql_likeness('p', 'd')}, 6) as likeness from p join c d on d.doc_id = p.other")
def chunk_likeness(spark, t):
    """Likeness of a chunk and the next of its language by words, path and lines."""
    from textquarry.operators.windows import similarity_to_previous

    like = lambda a, b: F.struct(a["doc_id"].alias("a"), SIM.likeness_of(a, b).alias("s"))
    rows = similarity_to_previous(located(t), "lang", F.col("doc_id"), like, {"code": SIM.similarity_tokens(F.col("code"))})
    return rows.where("similarity is not null").select(F.col("similarity.a").alias("a"), F.col("doc_id").alias("b"), number("similarity.s").alias("likeness"))


def candidates(t):
    d = t("documents")
    w = F.expr("row_number() over (partition by lang order by n_chars desc, doc_id)")
    c = d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.concat(F.lit("src/"), "source", F.lit(".ts")).alias("file"), F.lit(1).alias("start"), F.col("n_chars").cast("int").alias("end"), F.coalesce("text", F.lit("")).alias("code"), (F.col("n_chars") / 20000.0).alias("score"), w.alias("r"))
    return c.where("r <= 40").drop("r").withColumn("category", F.when(F.col("id") % 5 == 0, "modified").when(F.col("id") % 7 == 0, "test").otherwise("similar"))


@query()
def mmr_select(spark, t):
    """Diversified candidates of each query."""
    return SIM.diversify(candidates(t), 12).select("query_id", "id", number("score").alias("score"), "category")


@query()
def diversity_metrics(spark, t):
    """What diversification kept."""
    m = SIM.diversity_metrics(SIM.diversify(candidates(t), 12))
    return m.withColumn("avg_similarity", number("avg_similarity"))


@query("""with r as (select user_id % 60 as id, event_type as source, value / 100 as score, user_id % 7 = 0 as on_changed from events), m as (select id, max(score) as s, string_agg(distinct source, ',' order by source) as sources, count(distinct source) as n, bool_or(on_changed) as c from r group by id)
select id, sources, round(s * (1 + 0.15 * (n - 1)) * case when c then 1.5 else 1.0 end, 6) as score from m""")
def rerank_merge(spark, t):
    """Results of several sources merged and boosted."""
    r = t("events").select((F.col("user_id") % 60).alias("id"), F.col("event_type").alias("source"), (F.col("value") / 100).alias("score"), (F.col("user_id") % 7 == 0).alias("on_changed"))
    return SIM.merge_sources(r).select("id", F.array_join("sources", ",").alias("sources"), number("score").alias("score"))


@query("""select doc_id, round((case when doc_id % 3 = 0 then 2.0 else 1.0 end) * (case when doc_id % 5 = 0 then 1.3 else 1.0 end) * (case when lang = 'en' then 1.2 else 1.0 end) * (case when doc_id % 7 = 0 then 1.5 else 1.0 end), 6)::double as weight,
case when doc_id % 3 = 0 or doc_id % 7 = 0 or (doc_id % 5 = 0 and n_chars / 5000 > 0.7) then 'high' when n_chars / 5000 > 0.5 or doc_id % 5 = 0 then 'medium' else 'low' end as relevance from documents""")
def context_weights(spark, t):
    """Weights and relevance levels."""
    d = F.col("doc_id")
    return t("documents").select("doc_id", number(SIM.weight(d % 3 == 0, d % 5 == 0, F.when(F.col("lang") == "en", 1.2).otherwise(1.0), d % 7 == 0)).alias("weight"), RT.relevance(F.col("n_chars") / 5000, d % 3 == 0, d % 7 == 0, d % 5 == 0).alias("relevance"))


FILES = ("src/utils/helpers.ts", "main.py", "lib/a/b.go", "src/foo.test.ts", "README", "app/core.py")


WANTED_TESTS = {
    "src/utils/helpers.ts": "src/utils/helpers.test.ts,src/utils/helpers.spec.ts,src/utils/__tests__/helpers.ts,src/utils/__tests__/helpers.test.ts,src/utils/__tests__/helpers.spec.ts,test/utils/helpers.ts,test/utils/helpers.test.ts,test/utils/helpers.spec.ts,tests/utils/helpers.ts,tests/utils/helpers.test.ts,tests/utils/helpers.spec.ts,spec/utils/helpers.ts,spec/utils/helpers.test.ts,spec/utils/helpers.spec.ts",
    "main.py": "main_test.py,test_main.py,__tests__/main.py,__tests__/main.test.py,__tests__/main.spec.py,test/main.py,test/main_test.py,test/test_main.py,tests/main.py,tests/main_test.py,tests/test_main.py,spec/main.py,spec/main_test.py,spec/test_main.py",
    "lib/a/b.go": "lib/a/b.test.go,lib/a/b.spec.go,lib/a/__tests__/b.go,lib/a/__tests__/b.test.go,lib/a/__tests__/b.spec.go,test/a/b.go,test/a/b.test.go,test/a/b.spec.go,tests/a/b.go,tests/a/b.test.go,tests/a/b.spec.go,spec/a/b.go,spec/a/b.test.go,spec/a/b.spec.go",
    "src/foo.test.ts": "",
    "README": "README.test,README.spec,__tests__/README,__tests__/README.test,__tests__/README.spec,test/README,test/README.test,test/README.spec,tests/README,tests/README.test,tests/README.spec,spec/README,spec/README.test,spec/README.spec",
    "app/core.py": "app/core_test.py,app/test_core.py,app/__tests__/core.py,app/__tests__/core.test.py,app/__tests__/core.spec.py,test/core.py,test/core_test.py,test/test_core.py,tests/core.py,tests/core_test.py,tests/test_core.py,spec/core.py,spec/core_test.py,spec/test_core.py",
}


@query(f"select n_nationkey, {sql_pick(FILES, 'n_nationkey')} as path, {sql_pick([WANTED_TESTS[f] for f in FILES], 'n_nationkey')} as candidates from nation")
def test_path_candidates(spark, t):
    """Where tests of a file may be."""
    p = pick(FILES, F.col("n_nationkey"))
    return t("nation").select("n_nationkey", p.alias("path"), F.array_join(D.test_paths(p), ",").alias("candidates"))


@query("""with s as (select p_partkey, 'src/m' || p_partkey || '.ts' as source_file from part where p_partkey % 2 = 0), c as (select doc_id as id, 'src/m' || doc_id % 50 || case doc_id % 3 when 0 then '.test.ts' when 1 then '.spec.ts' else '.ts' end as file, n_chars as start, n_chars / 1000.0 as score from documents),
m as (select source_file, id, file, score, start, case when ends_with(file, '.test.ts') then 0 else 1 end as place from s join c on file in (replace(source_file, '.ts', '.test.ts'), replace(source_file, '.ts', '.spec.ts'))),
r as (select *, row_number() over (partition by source_file order by place, start, id) as n from m) select source_file, id, file, round(score * 1.5, 6)::double as score from r where n <= 3""")
def test_chunk_list(spark, t):
    """Chunks of the tests of changed files, three for each."""
    sources = t("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file"))
    k = F.col("doc_id")
    file = F.concat(F.lit("src/m"), (k % 50).cast("string"), F.when(k % 3 == 0, ".test.ts").when(k % 3 == 1, ".spec.ts").otherwise(".ts"))
    chunks = t("documents").select(k.alias("id"), file.alias("file"), F.col("n_chars").alias("start"), (F.col("n_chars") / 1000.0).alias("score"))
    return D.test_chunks(sources, chunks).withColumn("score", number("score"))


DIFFS = (
    "diff --git a/src/a.ts b/src/a.ts\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1,3 +1,4 @@\n keep\n-old line\n+new getUser(x)\n+added line\n keep",
    "diff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -10,2 +10,1 @@\n-gone\n ctx",
    "diff --git a/c.go b/c.go\n--- /dev/null\n+++ b/c.go\n@@ -0,0 +1,2 @@\n+func Alpha() {\n+}",
)


def diffs(t):
    return t("nation").select(F.col("n_nationkey").alias("id"), pick(DIFFS, F.col("n_nationkey")).alias("diff"))


WANTED_DIFF_LINE_TABLE = (
    (('src/a.ts', 2, 'new', 'modification', 'new getUser(x)'), ('src/a.ts', 3, 'new', 'addition', 'added line')),
    (('b.py', 10, 'old', 'deletion', 'gone'),),
    (('c.go', 1, 'new', 'addition', 'func Alpha() {'), ('c.go', 2, 'new', 'addition', '}')),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('file', 'line', 'side', 'change', 'content'), WANTED_DIFF_LINE_TABLE))
def diff_line_table(spark, t):
    """Changed lines with numbers and sides."""
    return D.changed_lines(diffs(t), "id", "diff")


WANTED_DIFF_LINES_BY_FILE = (
    (('src/a.ts', '3', '', '2', 'new getUser(x)\nadded line'),),
    (('b.py', '', '10', '', None),),
    (('c.go', '1,2', '', '', 'func Alpha() {\n}'),),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('file', 'additions', 'deletions', 'modifications', 'code'), WANTED_DIFF_LINES_BY_FILE))
def diff_lines_by_file(spark, t):
    """Line numbers by kind, and the new code."""
    lines = D.changed_lines(diffs(t), "id", "diff")
    both = D.lines_by_change(lines, "id").join(D.new_code(lines, "id"), ["id", "file"], "left")
    return both.select("id", "file", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("additions", "deletions", "modifications")], "code")


@query("with d as (select n_nationkey as id, n_nationkey % 3 as k from nation) select id, case k when 0 then 'src/a.ts' when 1 then 'b.py' else 'c.go' end as files, case k when 0 then 'src/a.ts' when 1 then 'b.py' else 'c.go' end as sources from d")
def diff_files(spark, t):
    """Files of a diff."""
    f = D.changed_files(F.col("diff"))
    return diffs(t).select("id", F.array_join(f, ",").alias("files"), F.array_join(D.source_files(f), ",").alias("sources"))


CODE_DIFF = "diff --git a/src/a.ts b/src/a.ts\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1,3 +1,4 @@\n keep\n-old line\n+export function getUser(id: UserId): Promise<User> {\n+import { foo, bar as baz } from './lib/x.js'\n keep"
WANTED_DIFF_QUERY_LIST = (
    (('', ''),),
    (('', ''),),
    (('Alpha|c Alpha Alpha', 'Alpha'),),
    (("baz|foo|User|UserId|getUser|Promise|lib x|foo, bar as baz|a getUser UserId Promise User User|export function getUser(id: UserId): Promise<User> {\nimport { foo, bar as baz } from './lib/x.js'", 'getUser|foo|bar|./lib/x.js'),),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('queries', 'symbols'), WANTED_DIFF_QUERY_LIST))
def diff_query_list(spark, t):
    """Queries and symbols that a diff suggests."""
    d = pick((*DIFFS, CODE_DIFF), F.col("n_nationkey"))
    return t("nation").select(F.col("n_nationkey").alias("id"), F.array_join(D.diff_queries(d), "|").alias("queries"), F.array_join(D.diff_symbols(d), "|").alias("symbols"))


DESCRIPTIONS = ("Fix src/a.ts and `getUser` in user_name of the UserStore, see lib/db/pool.py", "# Title\n\nThis long paragraph explains what happens with HTTP_RETRY handling.", "Add loadXml", "")


WANTED_DESCRIPTION_PARTS = (
    (('src/a.ts|lib/db/pool.py|getUser', 'UserStore|getUser|user_name', 'srcats|getUser|user|name|UserStore|libdbpoolpy', 'Fix src/a.ts and `getUser` in user_name of the UserStore, see lib/db/pool.py', 'src/a.ts|lib/db/pool.py|pool|getUser|UserStore|user_name|srcats|user'),),
    (('', 'HTTP_RETRY', 'Title|long|paragraph|explains|happens|HTTP|RETRY|handling', 'This long paragraph explains what happens with HTTP_RETRY handling.', 'HTTP_RETRY|Title|long|paragraph|explains|happens'),),
    (('', 'loadXml', 'loadXml', 'Add loadXml', 'loadXml'),),
    ((None, None, None, None, ''),),
)


@query(expected_rows('n_nationkey', "nation", "n_nationkey", ('paths', 'concepts', 'terms', 'summary', 'queries'), WANTED_DESCRIPTION_PARTS))
def description_parts(spark, t):
    """Paths, concepts, terms, summary and queries of a description."""
    p = D.description_parts(pick(DESCRIPTIONS, F.col("n_nationkey")))
    rows = t("nation").select("n_nationkey", p.alias("p")).withColumn("q", D.description_queries(F.col("p")))
    return rows.select("n_nationkey", *[F.array_join(f"p.{c}", "|").alias(c) for c in ("paths", "concepts", "terms")], "p.summary", F.array_join("q", "|").alias("queries"))


REQUESTS = "(select n_nationkey as query_id, ['tion', 'the', 'que', 'and', 'der', 'of'] as symbols, ['elle', 'a b', 'und', 'la le', 'is', 'ai', 'x', 'in', 'der', 'q'] as diff_queries, ['first', 'second', 'third', 'fourth', 'fifth'] as description_queries from nation)"


@query(f"""with r as (select * from {REQUESTS}), k as (select query_id, 'keyword' as stage, list_concat(symbols[1:5], list_filter(diff_queries, lambda q: regexp_matches(q, '^\\w+$'))[1:5]) as qs from r union all select query_id, 'vector', list_concat(diff_queries[1:8], description_queries[1:4]) from r)
select query_id, stage, cast(generate_subscripts(qs, 1) - 1 as integer) as position, unnest(qs) as query from k""")
def stage_query_list(spark, t):
    """What the keyword and the vector stage ask."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    r = t("nation").select(F.col("n_nationkey").alias("query_id"), lit(["tion", "the", "que", "and", "der", "of"]).alias("symbols"), lit(["elle", "a b", "und", "la le", "is", "ai", "x", "in", "der", "q"]).alias("diff_queries"), lit(["first", "second", "third", "fourth", "fifth"]).alias("description_queries"))
    return RT.stage_queries(r)


STAGE_ASKED = {1: "tion", 2: "the", 3: "que", 4: "und"}


def stage_hits(spark, t):
    """Ranked keyword hits of one request's four queries, with the boost of exact symbols."""
    from textquarry.functions.text import query_terms
    from textquarry.operators import search as S
    from textquarry.plans.search_queries import stored_index, symbol_docs

    q = spark.createDataFrame(list(STAGE_ASKED.items()), "query_id int, query string").withColumn("terms", query_terms(F.col("query")))
    found = S.keyword_search(S.index_scores(stored_index(t), q), symbol_docs(t), q, "doc_id", 15)
    return found.select(F.lit(1).alias("query_id"), F.col("query_id").alias("position"), F.col("doc_id").alias("id"), "score", "boost", "rank")


def _stage_sql() -> str:
    from textquarry.plans.search_queries import BM25, SQL_ASKED, SQL_SYMBOLS

    scores = BM25.replace(SQL_ASKED, " union all ".join(f"select {q} as query_id, '{x}' as term" for q, x in STAGE_ASKED.items())).rsplit("ranked as", 1)[0].rstrip().rstrip(",")
    asked = "case query_id " + " ".join(f"when {q} then '{x}'" for q, x in STAGE_ASKED.items()) + " end"
    return scores + f""", d as (select doc_id, {SQL_SYMBOLS} as symbols from w), f as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from scored join d using (doc_id)),
b as (select query_id, doc_id, score * case when list_contains(symbols, {asked}) then 3.0 else 1.0 end as score, list_contains(symbols, {asked}) as exact from f where r <= 30),
h as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from b), k as (select *, row_number() over (partition by doc_id order by query_id) as n from h where r <= 15),
keyword as (select doc_id as id, least(1.0, score / 10) * case when exact then 1.5 when score / 10 > 0.5 then 1.2 else 1.0 end as score, exact from k where n = 1)"""


@query(_stage_sql() + " select 1 as query_id, id, 'keyword' as source, round(score, 6) as score, exact as is_exact from keyword")
def keyword_stage(spark, t):
    """The keyword stage of a request: fifteen hits of each query, a chunk from the first that finds it."""
    return RT.keyword_stage(stage_hits(spark, t)).withColumn("score", number("score"))


def vector_hits(t):
    from textquarry.operators import search as S

    e = t("embeddings")
    q = e.where(F.col("vec_id").isin(0, 3, 8)).select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("q"))
    scored = S.vector_scores(e.withColumnRenamed("vec_id", "doc_id"), q, "doc_id", "embedding")
    return S.top_k(scored, 20).select(F.lit(1).alias("query_id"), F.col("query_id").alias("position"), F.col("doc_id").alias("id"), F.col("score").alias("vector_score"), "rank")


SQL_VECTOR_HITS = "(select q.vec_id as position, e.vec_id as id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as score, row_number() over (partition by q.vec_id order by list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) desc, e.vec_id) as rank from embeddings e, embeddings q where q.vec_id in (0, 3, 8))"


@query(_stage_sql() + f", v as (select * from {SQL_VECTOR_HITS} where rank <= 20 and id not in (select id from keyword)), f as (select *, row_number() over (partition by id order by position) as n from v) select 1 as query_id, id, 'vector' as source, round(score, 6) as score, false as is_exact from f where n = 1".replace("f as (select *, row_number() over (partition by id", "vf as (select *, row_number() over (partition by id").replace("from f where n = 1", "from vf where n = 1"))
def vector_stage(spark, t):
    """The vector stage: twenty hits of each query that the keyword stage has not found."""
    return RT.vector_stage(vector_hits(t), RT.keyword_stage(stage_hits(spark, t))).withColumn("score", number("score"))


@query(f"""with h as (select position, id, score, position = 8 as d from {SQL_VECTOR_HITS} where rank <= 20), f as (select id, max(score) as s, bool_or(d) as in_description from h group by id),
x as (select id, s * case when id % 4 = 0 then 2.0 else 1.0 end * case when in_description then 1.3 else 1.0 end * case when lang = 'en' then 1.2 else 1.0 end as score, text, id % 4 = 0 as is_modified, in_description, false as is_test from f join documents on doc_id = id
union all select doc_id, 1.5 * (doc_id % 100) / 100.0, text, false, false, true from documents where doc_id % 45 = 0),
b as (select *, row_number() over (partition by id order by score desc, is_test) as r from x), o as (select *, row_number() over (order by score desc, id) as n from b where r = 1),
u as (select *, sum(cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) + 50) over (order by score desc, id rows unbounded preceding) as used from o where n <= 40)
select 1 as query_id, id, round(score, 6)::double as score, cast(used as bigint) as used, is_modified, in_description, is_test from u where used <= 16000""")
def flat_retrieval(spark, t):
    """Hits of all queries, weights of changes, description and file type, tests besides, then the token budget."""
    d = t("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("code"), "lang")
    hits = vector_hits(t).select("query_id", "id", F.col("vector_score").alias("score"), (F.col("position") == 8).alias("of_description"))
    modified = d.where("id % 4 = 0").select(F.lit(1).alias("query_id"), "id")
    tests = d.where("id % 45 = 0").select(F.lit(1).alias("query_id"), "id", (F.lit(1.5) * (F.col("id") % 100) / 100.0).alias("score"))
    out = RT.flat_retrieval(hits, d, modified, tests, F.when(F.col("lang") == "en", 1.2).otherwise(1.0))
    return out.select("query_id", "id", number("score").alias("score"), long("used").alias("used"), "is_modified", "in_description", "is_test")


@query("""with c as (select doc_id as id, case doc_id % 3 when 0 then 'repo/src/' || source || '.ts' when 1 then 'src/' || source || '.ts' else source || '.py' end as file, 1 + doc_id % 30 as a, 1 + doc_id % 30 + n_chars % 20 as b from documents),
l as (select n_nationkey % 4 as query_id, case when n_nationkey % 5 = 0 then 'src' || n_nationkey || '.py' else 'src/src' || n_nationkey || '.ts' end as file, 5 + n_nationkey as line from nation)
select distinct query_id, id from c join l on (ends_with(c.file, l.file) or ends_with(l.file, c.file)) and line between a and b""")
def overlapping_chunk_list(spark, t):
    """Chunks that hold a changed line, also where one path is longer."""
    k, source = F.col("doc_id"), F.col("source")
    file = F.when(k % 3 == 0, F.concat(F.lit("repo/src/"), source, F.lit(".ts"))).when(k % 3 == 1, F.concat(F.lit("src/"), source, F.lit(".ts"))).otherwise(F.concat(source, F.lit(".py")))
    chunks = t("documents").select(k.alias("id"), file.alias("file"), (1 + k % 30).alias("start"), (1 + k % 30 + F.col("n_chars") % 20).alias("end"))
    n = F.col("n_nationkey")
    changed = F.when(n % 5 == 0, F.concat(F.lit("src"), n.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/src"), n.cast("string"), F.lit(".ts")))
    return RT.overlapping_chunks(chunks, t("nation").select((n % 4).alias("query_id"), changed.alias("file"), (5 + n).alias("line")))


@query("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), s as (select doc_id, ls, unnest(range(1, len(ls) + 1, 4)) as a from l), k as (select * from s where a = 1 or a + 1 <= len(ls))
select doc_id, cast(a as integer) as start_line, cast(least(a + 4, len(ls)) as integer) as end_line, array_to_string(ls[a:a + 4], chr(10)) as code from k where exists (select 1 from documents d where d.doc_id = k.doc_id and trim(d.text) <> '')""")
def line_chunks(spark, t):
    """Windows of five lines that share one."""
    return C.line_chunks(t("documents"), "doc_id", "text", 5, 1).select("doc_id", "start_line", "end_line", "code")


SOURCES = (
    ("python", "import os\n\n# adds\ndef add(a, b):\n    return sum([a, b])\n\nclass K:\n    def m(self):\n        self.n()\n"),
    ("typescript", "import { x } from './x'\nexport function go(a) {\n  return helper(a.b(1))\n}\nconst z = 1\n"),
    ("go", "package a\nimport \"fmt\"\nfunc Run() {\n\tfmt.Println(\"hi()\")\n}\n"),
    ("python", "def broken(:\n"),
)


def sources(t):
    k = F.col("n_nationkey")
    return t("nation").select(k.alias("id"), pick([s for s, _ in SOURCES], k).alias("language"), pick([c for _, c in SOURCES], k).alias("code"))


WANTED_CHUNK_AST = (
    (('3-5', 'function', 'add'), ('7-9', 'class', 'K,m'), ('1-2', 'other', '')),
    (('2-4', 'function', 'go'), ('1-1', 'other', ''), ('5-6', 'other', '')),
    (('3-5', 'function', 'Run'), ('1-2', 'other', '')),
    (('1-2', 'fallback', ''),),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('location', 'chunk_type', 'symbols'), WANTED_CHUNK_AST))
def chunk_ast(spark, t):
    """Chunks on the boundaries of definitions."""
    c = sources(t).select("id", F.inline(C.chunk_file(F.col("code"), F.col("language"))))
    return c.select("id", "location", "chunk_type", F.array_join("symbol_names", ",").alias("symbols"))


WANTED_CALL_EXTRACTION = (
    (('sum', None, False, 5, False), ('n', 'self', True, 9, False)),
    (('helper', None, False, 3, False), ('b', 'a', True, 3, False)),
    (('Println', 'fmt', True, 4, False),),
    (),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('callee', 'receiver', 'is_method', 'line', 'is_dynamic'), WANTED_CALL_EXTRACTION))
def call_extraction(spark, t):
    """GR5: calls in source files."""
    return sources(t).select("id", F.inline(C.file_calls(F.col("code"), F.col("language"))))


WANTED_DEFINITION_EXTRACTION = (
    (('add', 'function', 4, 5), ('K', 'class', 7, 9), ('m', 'function', 8, 9)),
    (('go', 'function', 2, 4),),
    (('Run', 'function', 3, 5),),
    (),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('symbol', 'kind', 'start_line', 'end_line'), WANTED_DEFINITION_EXTRACTION))
def definition_extraction(spark, t):
    """GR6 C7: definitions in source files."""
    return sources(t).select("id", F.inline(C.file_definitions(F.col("code"), F.col("language"))))


WANTED_IMPORT_EXPORT_LISTS = (
    (('os', ''),),
    (('./x', 'go'),),
    (('fmt', ''),),
    (('', ''),),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('imports', 'exports'), WANTED_IMPORT_EXPORT_LISTS))
def import_export_lists(spark, t):
    """Imports and exports."""
    c, g = F.col("code"), F.col("language")
    return sources(t).select("id", F.array_join(C.imports_of(c, g), ",").alias("imports"), F.array_join(C.exports_of(c, g), ",").alias("exports"))


WANTED_CONFIG_METADATA = (
    (('tsconfig', True, 'es2022', '', '', '', ''),),
    (('package_json', None, None, 'a,b', 'c', '', ''),),
    (('go_mod', None, '1.22', 'github.com/x/y', '', '', ''),),
    (('cargo', None, '2021', 'serde', 'tempfile', '', ''),),
    (('pyproject', None, None, 'numpy', '', '', ''),),
    (('eslint', None, None, '', '', 'no-console,semi', 'eslint:recommended,react'),),
)


@query(expected_rows('n_nationkey as id', "nation", "n_nationkey", ('config_type', 'strict_mode', 'target_version', 'dependencies', 'dev_dependencies', 'rules', 'extends'), WANTED_CONFIG_METADATA))
def config_metadata(spark, t):
    """What configuration files declare."""
    kinds = ("tsconfig", "package_json", "go_mod", "cargo", "pyproject", "eslint")
    bodies = ('{ // c\n "compilerOptions": {"strict": true, "target": "es2022",}, }', '{"dependencies": {"b": "1", "a": "2"}, "devDependencies": {"c": "3"}}', "module m\ngo 1.22\nrequire (\n\tgithub.com/x/y v1.2.3\n)", '[package]\nedition = "2021"\n[dependencies]\nserde = "1.0"\n[dev-dependencies]\ntempfile = "3"\n', '[project]\ndependencies = [\n  "numpy>=1",\n]\n', '{"extends": ["eslint:recommended"], "plugins": ["react"], "rules": {"semi": "error", "no-console": 1}}')
    k = F.col("n_nationkey")
    return t("nation").select(k.alias("id"), C.config_metadata(pick(bodies, k), pick(kinds, k)).alias("m")).select("id", *[f"m.{c}" for c in ("config_type", "strict_mode", "target_version")], *[F.array_join(f"m.{c}", ",").alias(c) for c in ("dependencies", "dev_dependencies", "rules", "extends")])


@query("""with p as (select page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') as parts from pages), x as (select parts, unnest(range(1, least(len(parts), 4) + 1)) as i from p)
select array_to_string(parts[1:i], '/') as node, cast(i as integer) as level, bool_or(i < len(parts)) as is_folder, count(*) as n_files from x group by all""")
def path_tree(spark, t):
    """The tree of paths down to four levels."""
    return C.path_tree(t("pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("p")), "p", 4)


@query("""with p as (select page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') as parts, page_id % 17 = 3 as m from pages), x as (select parts[1:i] as node, i as level, i < len(parts) as f, m from (select *, unnest(range(1, least(len(parts), 4) + 1)) as i from p)),
n as (select node, level, bool_or(f) as f, bool_or(m) as m from x group by all), u as (select a.node, a.level, a.f, a.m, list({'m': not b.m, 'f': not b.f, 'n': b.node[b.level], 'l': b.level} order by b.level) as place from n a join n b on b.level <= a.level and a.node[1:b.level] = b.node group by all),
o as (select *, row_number() over (order by place) as position from u) select cast(position as integer) as position, array_to_string(node, '/') as node, cast(level as integer) as level, f as is_folder, m as is_marked from o where position <= 50""")
def path_tree_lines(spark, t):
    """The first fifty lines of the tree: what is marked first, then folders, then by name."""
    p = t("pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("p"), (F.col("page_id") % 17 == 3).alias("m"))
    return C.tree_lines(p, "p", "m")


@query("""select page_id, length(h) as n, md5(h) as digest from (select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as h from pages)""")
def xml_escape(spark, t):
    """F12."""
    return t("pages").withColumn("h", X.escape_xml(F.col("html"))).select("page_id", F.length("h").cast("long").alias("n"), F.md5(F.col("h").cast("binary")).alias("digest"))


TAGGED = ("a <file> b </file >", "<FINDING x='1'>", "<p>plain</p>", "</import_tree foo>", "<cycle/>")


@query(f"""with s as (select page_id, {sql_pick(TAGGED, 'page_id')} as s from pages) select page_id, regexp_replace(regexp_replace(s, '(?i)</({'|'.join(X.SECTION_TAGS)})([^>]*)>', '<\\\\/\\1\\2>', 'g'), '(?i)<({'|'.join(X.SECTION_TAGS)})((?:\\s[^>]*)?\\s*/?)>', '<\\\\\\1\\2>', 'g') as clean from s""")
def sanitize_markup(spark, t):
    """section tags cannot close a section."""
    return t("pages").select("page_id", X.escape_tags(pick(TAGGED, F.col("page_id"))).alias("clean"))


RAW_TEXT = ("plain", "\x1b[31mred\x1b[0m", "a\rb\x07", "tab\tkept\n", "\x1b]0;title\x07after", "\x1b]8;;x\x1b\\link", "\x9b1mc1\x85")
PLAIN_TEXT = ("plain", "red", "ab", "tab\tkept\n", "after", "link", "c1")


@query(f"select n_nationkey, {sql_pick(PLAIN_TEXT, 'n_nationkey')} as clean from nation")
def terminal_text(spark, t):
    """without escape sequences and control characters."""
    return t("nation").select("n_nationkey", X.plain_terminal_text(pick(RAW_TEXT, F.col("n_nationkey"))).alias("clean"))


@query("""select p_partkey, sha1(concat_ws(chr(0), p_brand, p_name, cast(p_size as varchar), p_type))[:24] as finding_id, sha256(p_brand)[:16] as repo_id, sha256(concat_ws(':', p_brand, 'main', p_name, '1-9')) as chunk_id from part""")
def stable_ids(spark, t):
    """Ids from content."""
    c = F.col
    return t("part").select("p_partkey", X.finding_id(c("p_brand"), c("p_name"), c("p_size"), c("p_type")).alias("finding_id"), X.repo_id(c("p_brand")).alias("repo_id"), X.chunk_id(c("p_brand"), F.lit("main"), c("p_name"), F.lit("1-9")).alias("chunk_id"))


MESSAGES = (
    "HTTP 503 from host", "429 Too Many Requests", "socket hang up", "bad input", "did not complete within 30s", "status 404", "You hit your usage limit", "quota for this month exceeded", "rate-limited", "read ETIMEDOUT", "econnreset",
    "Service Unavailable: 503", "status 404 then HTTP 500", "Bad Gateway", "model overloaded",
)
KINDS_OF_FAILURE = ("retryable", "rate-limit", "transient", "permanent", "transient", "permanent", "rate-limit", "rate-limit", "rate-limit", "transient", "permanent", "retryable", "permanent", "permanent", "permanent")


@query(f"select event_id, {sql_pick(KINDS_OF_FAILURE, 'event_id')} as kind, least(10000.0, 1000.0 * power(2.0, event_id % 6)) as delay_ms from events")
def error_classes(spark, t):
    """F19 ST6: kinds of failure and the delay before a retry."""
    return t("events").select("event_id", X.error_class(pick(MESSAGES, F.col("event_id"))).alias("kind"), X.retry_delay_ms(F.col("event_id") % 6).alias("delay_ms"))


REFS = ("refs/pull/12/merge", "refs/heads/main", "refs/pull/7/head")
IMPORT_LINES = ("import { a, b as c } from './x.ts'", "import {type T} from 'y'", "import z from '/q/w.js'")
LONG_TEXTS = ("One. " * 100 + "tail", "Two words. " * 100, "x" * 700, " short ", "a" * 300 + "\n\n" + "b" * 300, "a" * 100 + "\n\n" + "b" * 500)
SUMMARIES = ("One. " * 99 + "One.", ("Two words. " * 45).strip(), "x" * 500 + "...", "short", "a" * 300, "a" * 100 + "\n\n" + "b" * 398 + "...")
HINTED = ("src/a.ts", "x/b.PY", "Makefile", "c.tar.yml", "d.unknown", "q.h")


@query(f"""select n_nationkey as id, [12, null, 7][n_nationkey % 3 + 1] as request, ['a/c', 'x', 'q/r'][n_nationkey % 3 + 1] as path, ['a,b', 'T', ''][n_nationkey % 3 + 1] as names, ['x', 'y', 'q/w'][n_nationkey % 3 + 1] as module,
['```', '````', '``````'][n_nationkey % 3 + 1] as fence, {sql_pick(SUMMARIES, 'n_nationkey')} as summary, ['typescript', 'python', '', 'yaml', '', 'c'][n_nationkey % 6 + 1] as hint, case when n_nationkey = 0 then '$1.50' else format('${{:.4f}}', 1.5 / (n_nationkey + 1)) end as cost from nation""")
def small_functions(spark, t):
    """Paths, imports, references, summaries, fences and hints."""
    k = F.col("n_nationkey")
    line = pick(IMPORT_LINES, k)
    return t("nation").select(
        k.alias("id"), X.request_number(pick(REFS, k)).alias("request"), X.normal_path(pick(("a/./b/../c", "../x", "/q//r/"), k)).alias("path"), F.array_join(X.named_imports(line), ",").alias("names"), X.clean_import_path(F.regexp_extract(line, r"['\"]([^'\"]+)['\"]", 1)).alias("module"),
        X.fence_for(pick(("a", "``` b", "`````"), k)).alias("fence"), X.summary_text(pick(LONG_TEXTS, k)).alias("summary"), X.language_hint(pick(HINTED, k)).alias("hint"), X.human_cost(F.lit(1.5) / (k + 1)).alias("cost"),
    )


def _finding(**changes) -> str:
    import json

    base = {"severity": "HIGH", "category": "correctness", "confidence": "HIGH", "title": "t", "file": "a.ts", "lineStart": 3, "lineEnd": 4, "evidence": "e", "problem": "p", "recommendation": "r"}
    return json.dumps({k: v for k, v in (base | changes).items() if v is not None})


def _review(*findings: str, tail: str = "") -> str:
    return 'text\n```findings\n{"findings": [' + ", ".join(findings) + "]}\n```" + tail


REVIEWS = (
    _review(_finding()), _review(_finding(), _finding(category="api-contract", lineEnd=3)), _review(), "no block", "```findings\n{broken\n```", _review(_finding(severity="BAD")), _review(_finding(confidence="high")), _review(_finding(category="bug")),
    _review(_finding(evidence=None)), _review(_finding(problem="  ")), _review(_finding(title="x" * 201)), _review(_finding(title="x" * 200)), _review(_finding(lineStart=0)), _review(_finding(lineEnd=2)), _review(_finding(lineStart="3")), '```findings\n{"other": 1}\n```',
    _review(_finding(severity="BAD"), tail="\n```findings\n{\"findings\": []}\n```"), " ```findings\n{}\n```",
)
OUTCOMES = ("ok", "ok", "ok", "missing", "invalid-json", "schema", "schema", "schema", "schema", "schema", "schema", "ok", "schema", "schema", "schema", "schema", "ok", "missing")
FOUND = (1, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0)


@query(f"select n_nationkey as id, {sql_pick(OUTCOMES, 'n_nationkey')} as outcome, {list(FOUND)}[n_nationkey % {len(FOUND)} + 1] as n from nation")
def finding_blocks(spark, t):
    """Outcome and findings of a review's last block."""
    r = t("nation").select(F.col("n_nationkey").alias("id"), pick(REVIEWS, F.col("n_nationkey")).alias("review"))
    return FN.parse_findings(r, "review").select("id", "outcome", F.size("findings").alias("n"))


MARKDOWN = (
    "## Summary\nAll good here.\n\n**[SEVERITY: HIGH]** - Bug: Off by one\nFile: a.ts:3-5\nProblem: wrong\nbound\n\nConfidence: LOW\n\n### Positive Observations\n- nice code here\n* too\n\n## Final Verdict\nRECOMMENDATION: REQUEST_CHANGES\nConfidence Level: HIGH\nMerge Decision: DO NOT MERGE\nRationale: it breaks\n\nIssues Summary: 1 CRITICAL, 2 HIGH, 0 MEDIUM, 4 LOW",
    "nothing", "RECOMMENDATION: APPROVE", "This review has no headings at all but a first paragraph.\n\nDecision: NEEDS_DISCUSSION", "CRITICAL: Security: token leaks\nFile: `b/c.py:7`\nIt is printed.\n\n**LOW** - small thing\nok\n",
)
PARSED = (
    ("All good here.", "HIGH|Bug|Off by one|a.ts|3|5|wrong\nbound|LOW", "nice code here", "REQUEST_CHANGES", "HIGH", "DO_NOT_MERGE", "it breaks", 1, 4),
    (None, None, None, None, None, None, None, None, None),
    ("RECOMMENDATION: APPROVE", "", "", "APPROVE", "MEDIUM", "SAFE_TO_MERGE", "", None, None),
    ("This review has no headings at all but a first paragraph.", "", "", "NEEDS_DISCUSSION", "MEDIUM", "CONDITIONAL_MERGE", "", None, None),
    ("CRITICAL: Security: token leaks\nFile: `b/c.py:7`\nIt is printed.", "CRITICAL|Security|token leaks|b/c.py|7||File: `b/c.py:7`\nIt is printed.|MEDIUM;LOW|General|small thing||||ok|MEDIUM", "", "NEEDS_DISCUSSION", "LOW", "CONDITIONAL_MERGE", "Could not parse verdict from review", None, None),
)


@query(expected("n_nationkey as id", "nation", "n_nationkey", ("summary", "issues", "positives", "recommendation", "confidence", "merge", "rationale", "critical", "low"), PARSED))
def markdown_reviews(spark, t):
    """summary, issues, positives, verdict and counts of a review."""
    rows = t("nation").select(F.col("n_nationkey").alias("id"), FN.parse_review(pick(MARKDOWN, F.col("n_nationkey"))).alias("r"))
    issue = lambda x: F.concat_ws("|", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in ("severity", "category", "title", "file", "line", "end_line", "description", "confidence")])
    lists = F.when(F.col("r.issues").isNotNull(), F.array_join(F.transform("r.issues", issue), ";")).alias("issues"), F.when(F.col("r.positives").isNotNull(), F.array_join("r.positives", ";")).alias("positives")
    return rows.select("id", "r.summary", *lists, *[f"r.{c}" for c in ("recommendation", "confidence", "merge", "rationale", "critical", "low")])


MARKED_REVIEWS = (
    "head\n**[SEVERITY: HIGH]** one\nFile: src/a.ts:2\n\n**[SEVERITY: LOW]** two\nFile: src/a.ts:9\n\nIssues Summary: 0 CRITICAL, 1 HIGH, 0 MEDIUM, 1 LOW\nRECOMMENDATION: APPROVE",
    "**[SEVERITY: CRITICAL]** x\nFile: src/b.ts:1\n### end\nIssues Summary: 0 CRITICAL, 0 HIGH, 0 MEDIUM, 0 LOW", "plain text", "**[SEVERITY: HIGH]** no place\n\nIssues Summary: 0 CRITICAL, 1 HIGH, 0 MEDIUM, 0 LOW",
)
UNMARKED = (
    ("head\n\n**[SEVERITY: LOW]** two\nFile: src/a.ts:9\n\nIssues Summary: 0 CRITICAL, 0 HIGH, 0 MEDIUM, 1 LOW\nRECOMMENDATION: APPROVE\n\nSuppressed: 1 finding via `review: ignore` markers.\n", 1),
    ("\n### end\nIssues Summary: 0 CRITICAL, 0 HIGH, 0 MEDIUM, 0 LOW\n\nSuppressed: 1 finding via `review: ignore` markers.\n", 1),
    ("plain text", 0), ("**[SEVERITY: HIGH]** no place\n\nIssues Summary: 0 CRITICAL, 1 HIGH, 0 MEDIUM, 0 LOW", 0),
)


@query(expected("n_nationkey as id", "nation", "n_nationkey", ("review", "n_suppressed"), UNMARKED))
def suppressed_reviews(spark, t):
    """issue blocks with a marked line go, and the summary line counts what stays."""
    r = t("nation").select(F.col("n_nationkey").alias("id"), pick(MARKED_REVIEWS, F.col("n_nationkey")).alias("review"))
    files = spark.createDataFrame([("src/a.ts", "x // review: ignore\ny\nz"), ("src/b.ts", "a\nb # review: ignore-file")], "file string, content string")
    return FN.drop_suppressed_blocks(r, "review", "id", files)


@query("""with lines as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), m as (select doc_id, n from lines where contains(l, 'token')),
f as (select doc_id, unnest([1, 2, 3, 4, 5]) as line from documents) select doc_id, line from f where (doc_id, line) not in (select (doc_id, n) from m union select (doc_id, n + 1) from m)""")
def suppression(spark, t):
    """Findings on or below a marked line are dropped."""
    d = t("documents")
    f = d.select(F.col("doc_id").cast("string").alias("file"), F.explode(F.array(*map(F.lit, range(1, 6)))).alias("lineStart"))
    files = d.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    return FN.suppressed(f, files, "token").select(F.col("file").cast("long").alias("doc_id"), F.col("lineStart").alias("line"))


CHANGES = "(select doc_id, case doc_id % 10 when 0 then 'A' when 1 then 'M' else 'D' end as change, doc_id as seq from documents where doc_id % 10 < 3)"


def change_rows(t):
    d = t("documents").where("doc_id % 10 < 3")
    k = F.col("doc_id") % 10
    return d.select("doc_id", F.concat("source", F.lit("+")).alias("source"), F.when(k == 0, "A").when(k == 1, "M").otherwise("D").alias("change"), F.col("doc_id").alias("seq"))


@query("""select doc_id, case when doc_id % 10 < 2 then source || '+' else source end as source from documents where doc_id % 10 <> 2""")
def cdc_apply(spark, t):
    """ST1 S8 G13: additions, changes and deletions; replay changes nothing."""
    return ST.apply_changes(t("documents").select("doc_id", "source"), change_rows(t), ["doc_id"])


@query("""select count(*) filter (doc_id % 10 < 2) as modified, count(*) filter (doc_id % 10 = 2) as deleted, count(*) filter (doc_id % 10 > 2) as unchanged, cast(0 as bigint) as added from documents""")
def cdc_counts(spark, t):
    """ST1: counters."""
    return ST.change_counts(t("documents").select("doc_id", "source"), change_rows(t), ["doc_id"]).select("modified", "deleted", "unchanged", "added")


@query("""select case page_id % 6 when 0 then 'A' when 4 then 'D' else 'M' end as change, 'p' || page_id || '.ts' as path from pages where page_id % 6 in (0, 2, 3, 4)
union all select 'D', 'old' || page_id || '.ts' from pages where page_id % 6 = 1 union all select 'A', 'p' || page_id || '.ts' from pages where page_id % 6 = 1""")
def change_set_rows(spark, t):
    """Name-status lines, in the three forms that they come in."""
    from textquarry.sources.files import change_set

    k = F.col("page_id")
    name = F.concat(F.lit("p"), k.cast("string"), F.lit(".ts"))
    line = F.when(k % 6 == 0, F.concat(F.lit("A\t"), name)).when(k % 6 == 1, F.concat(F.lit("R100\told"), k.cast("string"), F.lit(".ts\t"), name)).when(k % 6 == 2, F.concat(F.lit("M:"), name)).when(k % 6 == 3, name).when(k % 6 == 4, F.concat(F.lit("D\t"), name)).otherwise(F.concat(F.lit("C\t"), name, F.lit("\ty")))
    return change_set(t("pages").select(line.alias("value")))


@query("""select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_state(spark, t):
    """ST2 ST4: the last event of each key."""
    return ST.latest_state(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""with p as (select user_id, event_id, ts, event_type as head, value > 95 as failed, value > 50 as findings from events),
w as (select *, lag(head) over (partition by user_id order by ts, event_id) as before, coalesce(lag(findings) over (partition by user_id order by ts, event_id), false) as had, coalesce(bool_or(failed) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as dropped from p)
select user_id, event_id, case when dropped then 'drop' when before = head then 'skip' when before is not null and had then 'revalidate' else 'review' end as decision from w""")
def poll_decisions(spark, t):
    """ST4: what to do with a polled request, as a batch."""
    e = t("events").withColumnRenamed("event_type", "head")
    return ST.poll_decisions(e, "user_id", "head", ["ts", "event_id"], F.col("value") > 95, F.col("value") > 50).select("user_id", "event_id", "decision")


def queue_events(t):
    """Events as what happens to jobs of users and their kinds."""
    kind = F.when(F.col("event_id") % 3 == 0, "finish").when(F.col("event_id") % 7 == 0, "start").otherwise("enqueue")
    return t("events").select(F.col("user_id").cast("string").alias("repo"), "event_type", F.lit("main").alias("branch"), F.concat(F.lit("j"), "event_id").alias("job"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))


@query("""with e as (select cast(user_id as varchar) as repo, event_id as seq, ts, case when event_id % 3 = 0 then 'finish' when event_id % 7 = 0 then 'start' else 'enqueue' end as kind from events),
w as (select *, lag(kind) over (partition by repo order by ts, seq) as before from e where kind <> 'start') select repo, 'main' as branch, 'j' || seq as job, seq, case when coalesce(before, 'finish') = 'finish' then 'accepted' else 'duplicate' end as decision from w where kind = 'enqueue'""")
def job_decisions(spark, t):
    """ST2: enqueued jobs, of which one is pending or running per repository and branch."""
    return KS.job_decisions(queue_events(t))


@query("""with recursive e as (select cast(user_id as varchar) as feature, event_id as seq, 'o' || event_id % 3 as owner, case when event_id % 5 = 0 then 'release' else 'acquire' end as kind, epoch_ms(ts) as ms, row_number() over (partition by user_id order by ts, event_id) as i from events),
s(feature, i, seq, asks, decision, holder, since) as (select feature, i, seq, owner, case when kind = 'acquire' then 'acquired' else 'not held' end, case when kind = 'acquire' then owner end, case when kind = 'acquire' then ms end from e where i = 1
union all select e.feature, e.i, e.seq, e.owner,
  case when kind = 'release' then case when holder = owner then 'released' else 'not held' end when holder is null then 'acquired' when holder = owner then 'renewed' when ms - since > 43200000 then 'taken over' else 'refused' end,
  case when kind = 'release' then case when holder = owner then null else holder end when holder is null or holder = owner or ms - since > 43200000 then owner else holder end,
  case when kind = 'release' then case when holder = owner then null else since end when holder is null or holder = owner or ms - since > 43200000 then ms else since end
  from s join e on e.feature = s.feature and e.i = s.i + 1)
select feature, seq, asks as owner, decision from s""")
def lock_decisions(spark, t):
    """ST8: locks of features: acquired, refused, released, and taken over when stale."""
    kind = F.when(F.col("event_id") % 5 == 0, "release").otherwise("acquire")
    events = t("events").select(F.col("user_id").cast("string").alias("feature"), F.concat(F.lit("o"), (F.col("event_id") % 3).cast("string")).alias("owner"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))
    return KS.lock_decisions(events, 720)


@query("""select event_id, coalesce(epoch(ts) - epoch(lag(ts) over (partition by user_id, event_type order by ts)) <= 86400, false) as hit from events""")
def cache_ttl(spark, t):
    """ST5: hits of a cache with a time to live."""
    e = t("events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return ST.cache_hits(e, "key", "ts", 86_400).select("event_id", "hit")


@query()
def cache_lru(spark, t):
    """ST5: hits of caches of a hundred keys with a time to live."""
    e = t("events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id") % 3))
    return ST.lru_hits(e, "event_type", "key", ["ts", "event_id"], "ts", 100, 10 * 86_400)


@query("""select count(*) filter (ts < timestamp '2024-01-20 00:00:00' - interval 30 minutes) as stale, count(*) filter (event_type = 'purchase' and ts < timestamp '2024-01-20 00:00:00' - interval 24 hours) as expired from events""")
def stale_rows(spark, t):
    """ST8 F18: locks and finished jobs past their age."""
    now = F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    locks = ST.stale_locks(t("events").withColumnRenamed("ts", "acquired_at"), now).agg(F.count("*").alias("stale"))
    done = t("events").withColumnRenamed("ts", "completed_at").withColumn("status", F.when(F.col("event_type") == "purchase", "completed").otherwise("pending"))
    return locks.crossJoin(ST.expired(done, now).agg(F.count("*").alias("expired")))  # one row each


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all""")
def windowed_counts(spark, t):
    """Watermarked tumbling counts, on a table as on a stream."""
    return ST.windowed_counts(t("events"), "ts", "event_type")


SQL_REPORT = "(select user_id % 5 as feature_id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][event_id % 4 + 1] as severity, event_id % 4 as o, 't<' || event_type || '>' as title, 'a.ts' as file, cast(event_id as integer) as line from events)"
SQL_FORMS = {
    "text": "string_agg('[' || severity || '] ' || title || ' (' || file || ':' || line || ')', chr(10) order by o, title, file, line)",
    "markdown": "string_agg('- **' || severity || '** ' || title || ' `' || file || ':' || line || '`', chr(10) order by o, title, file, line)",
    "json": "'[' || string_agg('{\"severity\":\"' || severity || '\",\"title\":\"' || title || '\",\"file\":\"' || file || '\",\"line\":' || line || '}', ',' order by o, title, file, line) || ']'",
    "xml": "string_agg('<finding severity=\"' || severity || '\" at=\"' || file || ':' || line || '\">' || replace(replace(title, '<', '&lt;'), '>', '&gt;') || '</finding>', chr(10) order by o, title, file, line)",
}


@query(" union all ".join(f"select feature_id, {body} as body, '{form}' as form from {SQL_REPORT} group by feature_id" for form, body in SQL_FORMS.items()))
def report_bodies(spark, t):
    """Reports of a feature in four forms."""
    from textquarry.sources.files import report_lines

    f = t("events").select((F.col("user_id") % 5).alias("feature_id"), pick(FN.SEVERITIES, F.col("event_id")).alias("severity"), F.concat(F.lit("t<"), "event_type", F.lit(">")).alias("title"), F.lit("a.ts").alias("file"), F.col("event_id").cast("int").alias("line"))
    out = None
    for form in ("text", "markdown", "json", "xml"):
        part = report_lines(f, form).withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    return out


def part_chunks(t):
    k = F.col("p_partkey")
    word = lambda m: F.concat(F.get(F.split("p_name", " "), F.lit(1)), (k * m % 97).cast("string"))
    text = F.concat(F.lit(" "), word(5), F.lit(" x "), word(3), F.lit(".go "), word(2), F.lit("("))
    return t("part").select(k.alias("id"), text.alias("content"), F.array(word(1)).alias("symbols"), F.array(word(7)).alias("imports"), F.array(F.lit("* from ./x")).alias("exports"))


SQL_NOUN = "string_split(p_name, ' ')[2]"
PART_CHUNKS = f"(select p_partkey as id, ' ' || {SQL_NOUN} || p_partkey * 5 % 97 || ' x ' || {SQL_NOUN} || p_partkey * 3 % 97 || '.go ' || {SQL_NOUN} || p_partkey * 2 % 97 || '(' as content, {SQL_NOUN} || p_partkey % 97 as symbol, {SQL_NOUN} || p_partkey * 7 % 97 as imported from part)"


@query(f"""with c as (select * from {PART_CHUNKS}), i as (select distinct a.id as src, b.id as dst from c a join c b on a.imported = b.symbol and a.id <> b.id),
r as (select distinct a.id as src, b.id as dst from c a, c b where a.id <> b.id and length(b.symbol) >= 3 and ((contains(a.content, b.symbol || '(') and (a.id, b.id) not in (select (src, dst) from i)) or contains(a.content, b.symbol || '.') or contains(a.content, ' ' || b.symbol || ' ')))
select src, dst, 'imports' as kind from i union all select src, dst, 'references' from r""")
def chunk_relations(spark, t):
    """GR10 J10 J11 G6: imports and references between chunks."""
    return RT.relations(part_chunks(t))


SQL_ENDS = "(select item_id as id, regexp_extract(text, '([A-Za-z]{4}) ', 1) as symbol, string_split(text, ' ')[2] as imported from benchmark)"


@query(f"""with c as (select doc_id as id, text as content, '' as symbol, string_split(text, ' ')[2] as imported from documents), s as (select id + 10000000 as id, symbol from {SQL_ENDS} where length(symbol) >= 3),
i as (select distinct c.id as src, s.id as dst from c join s on c.imported = s.symbol),
r as (select distinct c.id as src, s.id as dst from c, s where (contains(content, s.symbol || '(') and (c.id, s.id) not in (select (src, dst) from i)) or contains(content, s.symbol || '.') or contains(content, ' ' || s.symbol || ' '))
select src, dst, 'imports' as kind from i union all select src, dst, 'references' from r""")
def symbol_references(spark, t):
    """J10 GR10: whole texts that hold the symbols of other chunks, which here are the ends of words and so stand inside of longer ones."""
    none = F.array().cast("array<string>")
    word = F.get(F.split("text", " "), F.lit(1))
    texts = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), none.alias("symbols"), F.array(word).alias("imports"), none.alias("exports"))
    names = t("benchmark").select((F.col("item_id") + 10_000_000).alias("id"), F.lit("").alias("content"), F.array(F.regexp_extract("text", "([A-Za-z]{4}) ", 1)).alias("symbols"), none.alias("imports"), none.alias("exports"))
    return RT.relations(texts.unionByName(names))


STRATEGY_FILES = (
    ("src/a.ts", "class A extends Base implements Shape { x: Thing = load(1) }\nimport { foo, bar } from './lib'"),
    ("lib/m.py", "from os import path\nclass K(Parent):\n    @cached(1)\n    def run(self, a: Item) -> Result: pass"),
    ("pkg/s.go", 'import "fmt"\ntype Store interface {}\nfunc (s *Server) Run() {}'),
    ("x.scss", "@include flex; color: $main; @extend %card; width: var(--gap)"),
    ("lib/x.mjs", "const go = (a) => a\nimport one from 'two'"),
    ("notes.txt", "class A extends Base"),
)
WANTED_STRATEGY_QUERIES = (
    (("typescript", "interface Thing=1.5,class Base=1.6,interface Shape=1.6,foo, bar ./lib=1.4", "interface Thing,class Base,interface Shape,foo, bar ./lib", "src/a.d.ts,src/a.types.ts,src/a/types.ts,types/a.ts,src/index.ts,src/index.tsx", 1.5),),
    (("python", "class Parent=1.6,def cached=1.5,class Result=1.4,class Item=1.4,path=1.4", "class Parent,def cached,class Result,class Item,path,run,cached", "lib/__init__.py,lib/base.py,lib/abc.py,lib/interfaces.py,lib/conftest.py,conftest.py", 1.5),),
    (("go", "interface Store=1.6,type Server=1.5,fmt=1.3", "interface Store,type Server,fmt,Run,Store", "pkg/doc.go,pkg/interfaces.go,pkg/types.go,pkg/contract.go", 1.5),),
    (("scss", "--gap=1.6,$$main=1.6,@mixin flex=1.7,%card=1.6", "--gap,$$main,@mixin flex,%card,gap,main", "_variables.scss,variables.scss,_mixins.scss,mixins.scss,_base.scss,base.scss", 1.5),),
    (("javascript", "one=1.4", "one", "lib/index.js,lib/index.mjs", 2.0),),
    (("generic", "", "", "", 1.0),),
)


@query(expected_rows("n_nationkey as id", "nation", "n_nationkey", ("kind", "priority", "queries", "related", "weight"), WANTED_STRATEGY_QUERIES).replace("x.weight", "cast(x.weight as double) as weight"))
def strategy_queries(spark, t):
    """What a file's type looks for, the files that belong to it, and the weight of its chunks with an override."""
    n = F.col("n_nationkey")
    path, code = pick([p for p, _ in STRATEGY_FILES], n), pick([c for _, c in STRATEGY_FILES], n)
    kind = RT.file_type(path)
    shown = F.array_join(F.transform(RT.priority_queries(kind, code), lambda x: F.concat_ws("=", x["query"], x["weight"].cast("string"))), ",")
    weight = RT.strategy_weight(kind, {"javascript": 2.0})
    return t("nation").select(n.alias("id"), kind.alias("kind"), shown.alias("priority"), F.array_join(RT.strategy_queries(kind, code), ",").alias("queries"), F.array_join(RT.related_paths(path), ",").alias("related"), weight.alias("weight"))


@query("""with p as (select p_partkey as id, p_brand as file, p_size as line, unnest(string_split(p_name, ' ')) as symbol from part), a as (select symbol, row_number() over (order by symbol) as position from (select distinct symbol from p order by symbol limit 8)),
s as (select *, 0 as o from p where id % 4 = 0 union all select *, 1 from p where id % 4 <= 1 and id % 8 < 4 union all select *, 2 from p where id % 5 = 2 union all select *, 3 from p where id % 5 = 3),
r as (select s.id, s.symbol, position, o, row_number() over (partition by s.symbol, o order by file, line, s.id) as r from s join a using (symbol)),
k as (select * from r where r <= case o when 0 then 10 when 1 then 15 else 5 end), f as (select *, row_number() over (partition by id order by position, o) as x from k)
select id, ['definition', 'usage', 'caller', 'callee'][o + 1] as source, round([1.04, 0.77, 0.9, 0.84][o + 1], 6)::double as score, o = 0 as is_exact, symbol from f where x = 1""")
def structural_stage(spark, t):
    """Definitions, usages, callers and callees of asked symbols."""
    from pyspark.sql import Window

    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.explode(F.split("p_name", " ")).alias("symbol"))
    asked = p.select("symbol").distinct().orderBy("symbol").limit(8).withColumn("position", F.row_number().over(Window.orderBy("symbol")))
    out = RT.structural_stage(asked, p.where("id % 4 = 0"), p.where("id % 4 <= 1 and id % 8 < 4"), p.where("id % 5 = 2"), p.where("id % 5 = 3"))
    return out.select("id", "source", number("score").alias("score"), "is_exact", "symbol")


STAGED = "(select user_id % 20 as query_id, event_id as id, event_type as source, value / 100 as score, event_id % 9 = 0 as is_exact from events where event_type = '{}')"


@query(f"""with a as (select * from {STAGED.format('view')}), n as (select *, row_number() over (partition by query_id order by score desc, id) as r from a where score > 0.8),
d as (select query_id from n group by query_id having count(*) >= 5 and (count(*) filter (r <= 3 and score > 0.9) >= 3 or count(*) filter (is_exact) >= 5)),
u as (select query_id, id, source, score, is_exact from a where score > 0.8 union all select query_id, id, source, score, is_exact from {STAGED.format('click')} where query_id not in (select query_id from d)),
f as (select *, row_number() over (partition by query_id order by score desc, id) as rank from u) select query_id, id, source, round(score, 6) as score, cast(rank as integer) as rank from f where rank <= 20""")
def staged_retrieval(spark, t):
    """Stages of which a sure query skips the later ones."""
    e = t("events").select((F.col("user_id") % 20).alias("query_id"), F.col("event_id").alias("id"), F.col("event_type").alias("source"), (F.col("value") / 100).alias("score"), (F.col("event_id") % 9 == 0).alias("is_exact"))
    return RT.staged([e.where("source = 'view' and score > 0.8"), e.where("source = 'click'")]).select("query_id", "id", "source", number("score").alias("score"), "rank")


#: Requests: the names that each asks for, and the vectors that it compares.
ASKED_NAMES = {1: ("tion", "the"), 2: ("que", "elle"), 3: ("edonre",), 4: ("der",)}
ASKED_VECTORS = {1: (0,), 2: (3, 8), 3: (5,)}


def _staged_sql() -> str:
    from textquarry.plans.search_queries import BM25, SQL_ASKED, SQL_SYMBOLS

    names = [(r, i, x) for r, xs in ASKED_NAMES.items() for i, x in enumerate(xs)]
    scores = BM25.replace(SQL_ASKED, " union all ".join(f"select {10 * r + i} as query_id, '{x}' as term" for r, i, x in names)).rsplit("ranked as", 1)[0].rstrip().rstrip(",")
    cosine = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"
    stop = lambda rows: f"(select query_id from (select *, row_number() over (partition by query_id order by score desc, id) as r from {rows}) group by query_id having count(*) >= 5 and (count(*) filter (r <= 3 and score > 0.9) >= 3 or count(*) filter (is_exact) >= 5))"
    return scores + f""", names(request, place, name) as (values {", ".join(f"({r}, {i}, '{x}')" for r, i, x in names)}), vectors(request, place, vec) as (values {", ".join(f"({r}, {i}, {v})" for r, vs in ASKED_VECTORS.items() for i, v in enumerate(vs))}),
d as (select doc_id, {SQL_SYMBOLS} as symbols, source, n_chars, text from w join documents using (doc_id)),
f as (select request, place, name, doc_id, score, symbols, row_number() over (partition by request, place order by score desc, doc_id) as r from scored join names on query_id = 10 * request + place join d using (doc_id)),
b as (select *, score * case when list_contains(symbols, name) then 3.0 else 1.0 end as s, list_contains(symbols, name) as exact from f where r <= 30),
h as (select *, row_number() over (partition by request, place order by s desc, doc_id) as k from b),
o as (select *, row_number() over (partition by request, doc_id order by place) as n from h where k <= 15),
kw as (select request as query_id, doc_id as id, 'keyword' as source, least(1.0, s / 10) * case when exact then 1.5 when s / 10 > 0.5 then 1.2 else 1.0 end as score, exact as is_exact, 0 as stage from o where n = 1),
vh as (select request, place, e.vec_id as id, {cosine} as c, row_number() over (partition by request, place order by {cosine} desc, e.vec_id) as k from vectors join embeddings q on q.vec_id = vec, embeddings e where e.vec_id in (select doc_id from documents)),
vo as (select *, row_number() over (partition by request, id order by place) as n from vh where k <= 20 and (request, id) not in (select (query_id, id) from kw) and request not in {stop('kw')}),
one as (select * from kw union all select request, id, 'vector', c, false, 1 from vo where n = 1),
places as (select doc_id, unnest(ws) as term, unnest(range(len(ws))) as pos from w), users as (select term, doc_id, min(pos) as line from places where term in (select name from names) group by all),
hits as (select request, place, doc_id, source, list_position(symbols, name) as line, 0 as kind from names join d on list_contains(symbols, name) union all select request, place, users.doc_id, source, line, 1 from names join users on term = name join d on d.doc_id = users.doc_id),
capped as (select *, row_number() over (partition by request, place, kind order by source, line, doc_id) as k from hits),
so as (select *, row_number() over (partition by request, doc_id order by place, kind) as n from capped where k <= case kind when 0 then 10 else 15 end),
two as (select * from one union all select request, doc_id, case kind when 0 then 'definition' else 'usage' end, case kind when 0 then 0.8 * 1.3 else 0.7 * 1.1 end, kind = 0, 2 from so where n = 1 and (request, doc_id) not in (select (query_id, id) from one) and request not in {stop('one')}),
m as (select query_id, id, source, score * case when id % 4 = 0 then 1.5 else 1.0 end as score, stage from two),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from m),
t as (select r.*, sum(ceil(length(text) / 4.0) + 50) over (partition by query_id order by rank) as used from r join (select doc_id, text from documents) x on x.doc_id = r.id where rank <= 20)
select query_id, id, source, round(score, 6) as score, stage, cast(rank as integer) as rank from t where used <= 16000"""


@query(_staged_sql())
def staged_search(spark, t):
    """The three stages of several requests over documents, one after the other, reranked and packed."""
    from textquarry.operators import search as S
    from textquarry.plans.search_queries import stored_index, symbol_docs

    names = [(r, i, x) for r, xs in ASKED_NAMES.items() for i, x in enumerate(xs)]
    asked = spark.createDataFrame([(10 * r + i, r, i, x) for r, i, x in names], "query_id int, request int, position int, symbol string")
    index, symbols = stored_index(t), symbol_docs(t)
    found = S.keyword_search(S.index_scores(index, asked.select("query_id", F.array("symbol").alias("terms"))), symbols, asked.select("query_id", F.col("symbol").alias("query")), "doc_id", 15)
    keyword = found.join(asked, "query_id").select(F.col("request").alias("query_id"), "position", F.col("doc_id").alias("id"), "score", "boost", "rank")
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    wanted = spark.createDataFrame([(10 * r + i, r, i, v) for r, vs in ASKED_VECTORS.items() for i, v in enumerate(vs)], "query_id int, request int, position int, vec long")
    mine = e.join(t("documents").select("doc_id"), "doc_id", "left_semi")
    near = S.top_k(S.vector_scores(mine, wanted.join(e, F.col("vec") == e.doc_id).select("query_id", F.col("embedding").alias("q")), "doc_id", "embedding"), 20)
    vector = near.join(wanted, "query_id").select(F.col("request").alias("query_id"), "position", F.col("doc_id").alias("id"), F.col("score").alias("vector_score"), "rank")
    place = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("text").alias("code"))
    defined = symbols.select(F.col("doc_id").alias("id"), F.posexplode("symbols").alias("line", "symbol")).join(S.few(asked.select("symbol").distinct()), "symbol", "left_semi").join(place.select("id", "file"), "id")
    used = index.of(asked.select(F.col("symbol").alias("term"))).select(F.col("term").alias("symbol"), F.col("doc_id").alias("id"), F.array_min("positions").alias("line")).join(place.select("id", "file"), "id")
    structural = RT.structural_stage(asked.select(F.col("request").alias("query_id"), "symbol", "position"), defined, used, by="query_id")
    modified = t("documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"))
    out = RT.staged_retrieval(keyword, vector, structural, place, modified)
    return out.select("query_id", "id", "source", number("score").alias("score"), "stage", "rank")


@query("select doc_id, round(least(1.0, n_chars / 1000.0 / 10) * case when doc_id % 4 = 0 then 1.5 when least(1.0, n_chars / 1000.0 / 10) > 0.5 then 1.2 else 1.0 end, 6)::double as weight from documents")
def keyword_stage_weights(spark, t):
    """Keyword scores as weights."""
    return t("documents").select("doc_id", number(RT.keyword_stage_weight(F.col("n_chars") / 1000.0, F.col("doc_id") % 4 == 0)).alias("weight"))


@query()
def xml_contexts(spark, t):
    """What a request is shown."""
    c = candidates(t).withColumn("is_modified", F.col("id") % 5 == 0).withColumn("is_test", F.col("id") % 7 == 0).withColumn("source_file", F.when(F.col("id") % 2 == 0, "src/x.ts")).withColumn("in_description", F.col("id") % 3 == 0)
    return RT.xml_context(c)


TOOL_PATHS = ("src/a.ts", "config/.env", "lib/b.py", "keys/x.pem", "docs/c.md")


@query(f"""with r as (select doc_id, {sql_pick(TOOL_PATHS, 'doc_id')} as path, row_number() over (order by n_chars desc, doc_id) as rank from documents) select doc_id, path, cast(rank as integer) as rank from r where rank <= 50 and path not in ('config/.env', 'keys/x.pem')""")
def tool_search(spark, t):
    """The clamp of a tool's limit, then no secrets."""
    d = t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(100).withColumn("rank", F.expr("row_number() over (order by n_chars desc, doc_id)").cast("int"))
    return RT.tool_results(d.select("doc_id", pick(TOOL_PATHS, F.col("doc_id")).alias("path"), "rank"), "path", 500)


@query("""with k as (select n_nationkey as n from nation) select n || '/package.json' as path, '{"dependencies": {"a": "1"}}' as code, 1 as start_line, 1 as end_line, 'config' as chunk_type, 'package_json,a' as symbol_names from k where n % 3 = 0
union all select n || '/go.mod', 'module m' || chr(10) || 'go 1.22' || chr(10), 1, 3, 'config', 'go_mod,1.22' from k where n % 3 = 2""")
def config_chunk_list(spark, t):
    """One chunk per configuration file."""
    k = F.col("n_nationkey")
    f = t("nation").select(F.concat(k.cast("string"), F.lit("/"), pick(("package.json", "a.ts", "go.mod"), k)).alias("path"), pick(('{"dependencies": {"a": "1"}}', "x", "module m\ngo 1.22\n"), k).alias("content"))
    return RT.config_chunks(f, "path", "content").withColumn("symbol_names", F.array_join("symbol_names", ","))


@query("""select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source, case when doc_id % 3 = 0 then cast(0 as bigint) else n_chars end as n_chars from documents union all select doc_id + 10000000, 'new', cast(0 as bigint) from documents where doc_id % 50 = 0""")
def upsert_rows(spark, t):
    """Rows of equal keys are replaced, others added."""
    from textquarry.sources.files import upsert

    d = t("documents").select("doc_id", "source", "n_chars")
    new = d.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"), F.lit(0).cast("long").alias("n_chars")).unionByName(d.where("doc_id % 50 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("new").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    return upsert(d, new, ["doc_id"])


def _glob_sql() -> str:
    from textquarry.plans.analytics_queries import SQL_PATH
    from textquarry.sources.patterns import EXCLUDED, INCLUDED

    plain = lambda names: "|".join(n.replace(".", "\\.").replace("*", "[^/]*") for n in names)
    folders = [g[3:-3] for g in EXCLUDED if g.endswith("/**") and g.count("**") == 2]
    files = [g[3:] for g in EXCLUDED if not g.endswith("/**")]
    kept = f"regexp_matches(path, '(^|/)({plain(g[3:] for g in INCLUDED)})$') and not regexp_matches(path, '(^|/)({plain(folders)})/') and not regexp_matches(path, '(^|/)({plain(files)})$')"
    return f"with x as (select page_id, {SQL_PATH} as path, length(html) as size from pages) select page_id, path, {kept} and coalesce(size, 0) <= 10000000 as kept from x"


@query(_glob_sql())
def glob_filter(spark, t):
    """All patterns that include and exclude, and the cap on sizes."""
    from textquarry.plans.analytics_queries import paths
    from textquarry.sources.patterns import indexed

    sizes = t("pages").select("page_id", F.length("html").alias("size"))
    kept = indexed(F.col("path"), F.col("size"))
    return paths(t).join(sizes, "page_id").select("page_id", "path", kept.alias("kept"))


@query("""select cast(o_orderkey as varchar) as sha, o_orderpriority as author, o_orderstatus as date, 'order ' || o_custkey as subject from orders where o_orderkey % 7 <> 0""")
def commit_rows(spark, t):
    """Records of a log, blank ones dropped."""
    from textquarry.sources.files import commit_fields

    record = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus", F.concat(F.lit("order "), F.col("o_custkey").cast("string")))
    return commit_fields(t("orders").select(F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit("\n"), record)).alias("value")))


@query("""select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events where event_id % 6 <> 0 group by 1""")
def json_record_rows(spark, t):
    """Records by an explicit schema, malformed ones skipped."""
    from textquarry.sources.files import parsed_records

    body = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("{broken"), F.col("props"))).otherwise(F.col("props"))
    return parsed_records(t("events").select(body.alias("b")), "b", "k long").groupBy("k").agg(F.count("*").alias("n"))


@query("""select lang, n, 'first' as run from (select lang, count(*) as n from documents group by lang) union all select lang, n + 1, 'second' from (select lang, count(*) as n from documents group by lang)""")
def jsonl_history(spark, t):
    """Records of two runs appended to one history of JSON lines."""
    from textquarry.sources.files import append_jsonl

    out, counts = fresh_dir(spark, "history"), t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    append_jsonl(counts.withColumn("run", F.lit("first")), out)
    append_jsonl(counts.select("lang", (F.col("n") + 1).alias("n"), F.lit("second").alias("run")), out)
    return spark.read.schema("lang string, n long, run string").json(out)


@query("select doc_id, case when lang = 'en' then 'replaced' else source end as source, lang from documents where lang is not null")
def replaced_partitions(spark, t):
    """Records of some partitions replaced in one atomic job, the others as they were."""
    from textquarry.sources.files import overwrite_partitions

    out, d = fresh_dir(spark, "records"), t("documents").where("lang is not null").select("doc_id", "source", "lang")
    overwrite_partitions(d, out, ["lang"])
    overwrite_partitions(d.where("lang = 'en'").withColumn("source", F.lit("replaced")), out, ["lang"])
    return spark.read.schema("doc_id long, source string, lang string").parquet(out)


@query("""select 'pkg' || n_nationkey % 3 || '/f' || n_nationkey || case n_nationkey % 4 when 0 then '.py' when 1 then '.ts' else '.go' end as file, 'x = ' || n_nationkey as content, case n_nationkey % 4 when 0 then 'python' when 1 then 'typescript' else 'go' end as language, cast(length('x = ' || n_nationkey) as bigint) as size from nation where n_nationkey % 4 < 3 and n_nationkey % 5 > 0""")
def scanned_files(spark, t):
    """A tree of files by extension, without excluded folders."""
    from textquarry.sources.files import source_files

    root, k = fresh_dir(spark, "tree"), F.col("n_nationkey")
    folder = F.when(k % 5 == 0, "node_modules").otherwise(F.concat(F.lit("pkg"), (k % 3).cast("string")))
    name = F.concat(folder, F.lit("/f"), k.cast("string"), F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".ts").when(k % 4 == 2, ".go").otherwise(".txt"))
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in t("nation").select(name.alias("name"), F.concat(F.lit("x = "), k.cast("string")).alias("content")).collect():  # the 25 files of the tree
        sink = files.create(place(f"{root}/{r.name}"))
        sink.write(bytearray(r.content.encode()))
        sink.close()
    return source_files(spark, root).select("file", "content", "language", "size")


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all""")
def live_counts(spark, t):
    """ST9: the live twin of windowed_counts: a stream over the table, each batch written in place of the one before."""
    out, schema = fresh_dir(spark, "live"), t("events").schema
    counts = ST.windowed_counts(spark.readStream.schema(schema).parquet(t.path("events") + "*"), "ts", "event_type")
    live = counts.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).option("checkpointLocation", fresh_dir(spark, "progress")).trigger(availableNow=True).start()
    live.awaitTermination()
    return spark.read.parquet(out)


@query("""select user_id as k, min(ts) as start, count(*) as n from (select *, sum(case when gap is null or gap > 1800 then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select *, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events)) group by user_id, s""")
def session_counts(spark, t):
    """Sessions that end after half an hour without an event."""
    return ST.session_counts(t("events"), "ts", "user_id").select(F.col("user_id").alias("k"), "start", "n")
