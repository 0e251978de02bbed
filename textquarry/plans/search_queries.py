"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.text import identifier_variations, query_terms, quoted_phrases, tokens, without_phrases
from textquarry.operators import search as S
from textquarry.operators.segments import SegmentedIndex
from textquarry.operators.trigrams import TrigramIndex
from textquarry.operators.windows import top_per_group
from textquarry.plans.registry import long, number, pick, query, sql_list, sql_pick
from textquarry.storage import built_once, fresh_dir

ASKED = {1: ["tion", "the", "edonre"], 2: ["que", "elle"], 3: ["der", "enheit", "ungen"], 4: ["worthless"]}
SQL_TOKENS = r"regexp_extract_all(lower(replace(regexp_replace(coalesce(text,''), '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '_', ' ')), '[\p{L}\p{N}]+')"
SQL_ASKED = " union all ".join(f"select {q} as query_id, unnest({sql_list(ts)}) as term" for q, ts in ASKED.items())


def asked(spark):
    return spark.createDataFrame([(q, ts) for q, ts in ASKED.items()], "query_id int, terms array<string>")


def stored_index(t):
    """The index of the documents, written when it is first asked for and read by all searches of the session."""
    path = built_once(t.spark, "index", t.path("documents"), lambda out: S.Index.write(t("documents"), "doc_id", "text", out))
    return S.Index(t.spark, path, "doc_id")


BM25 = f"""
with w as (select doc_id, {SQL_TOKENS} as ws from documents),
asked as ({SQL_ASKED}),
stat as (select count(*) as n, avg(len(ws)) as avg_len from w),
tok as (select doc_id, len(ws) as len, unnest(ws) as term from w),
tf as (select doc_id, len, term, count(*) as tf from tok where term in (select term from asked) group by all),
df as (select term, count(*) as df from tf group by term),
scored as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) as score
  from tf join df using (term) join asked using (term), stat group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)
"""


@query(BM25 + "select query_id, doc_id, round(score, 6) as score, cast(rank as integer) as rank from ranked where rank <= 10")
def keyword_bm25_topk(spark, t):
    """BM25 from the stored index, ten best for each of several queries."""
    scored = S.index_scores(stored_index(t), asked(spark))
    return S.top_k(scored, 10).select("query_id", "doc_id", number("score").alias("score"), "rank")


@query(f"""
with w as (select doc_id, {SQL_TOKENS} as ws from documents), asked as ({SQL_ASKED}), tok as (select doc_id, len(ws) as len, unnest(ws) as term from w)
select query_id, doc_id, round(count(*) / (1 + ln(max(len))), 6) as score from tok join asked using (term) group by query_id, doc_id""")
def keyword_rank_cd(spark, t):
    """K5 in its length-normalised form."""
    return S.rank_cd_approx(stored_index(t), asked(spark)).select("query_id", "doc_id", number("score").alias("score"))


@query(f"""
with w as (select doc_id, {SQL_TOKENS} as ws from documents), asked as ({SQL_ASKED}), tok as (select doc_id, len(ws) as len, unnest(ws) as term from w)
select query_id, doc_id, round(0.1 * count(*) / ln(max(len) + 1), 6) as score from tok join asked using (term) group by query_id, doc_id""")
def keyword_cover_rank(spark, t):
    """K5: cover density of any of the terms, divided by the logarithm of the length."""
    return S.cover_scores(stored_index(t), asked(spark)).select("query_id", "doc_id", number("score").alias("score"))


COVERED = {1: ["the", "of", "and"], 2: ["de", "la"], 3: ["und", "der"]}


@query(f"""
with w as (select doc_id, {SQL_TOKENS} as ws from documents), tok as (select doc_id, len(ws) as len, unnest(ws) as term, unnest(range(len(ws))) as pos from w),
asked(query_id, n, no, term) as (values {", ".join(f"({q}, {len(ts)}, {i}, '{x}')" for q, ts in COVERED.items() for i, x in enumerate(ts))}),
e as (select query_id, doc_id, len, n, pos, no, row_number() over (partition by query_id, doc_id order by pos) as i from tok join asked using (term)),
m as (select *, max(case when no = 0 then pos end) over o as p0, max(case when no = 1 then pos end) over o as p1, case when n > 2 then max(case when no = 2 then pos end) over o else pos end as p2 from e window o as (partition by query_id, doc_id order by pos)),
c as (select query_id, doc_id, len, least(p0, p1, p2) as p, min(pos) as q, min(i) as iq from m where p0 is not null and p1 is not null and p2 is not null group by all)
select query_id, doc_id, round(sum(0.1 / (1 + (q - p) - (iq - e.i))) / ln(max(c.len) + 1), 6) as score from c join e using (query_id, doc_id) where e.pos = c.p group by query_id, doc_id""")
def keyword_cover_every(spark, t):
    """K5: cover density of all terms together."""
    queries = spark.createDataFrame(list(COVERED.items()), "query_id int, terms array<string>")
    return S.cover_scores(stored_index(t), queries, every=True).select("query_id", "doc_id", number("score").alias("score"))


@query(BM25.replace("from documents)", "from (select doc_id, case when doc_id % 7 = 0 then 'tion worthless ' || text else text end as text from documents where doc_id % 11 <> 0))") + "select query_id, doc_id, round(score, 6) as score from scored")
def index_upkeep(spark, t):
    """K1 ST1 ST9: an index that took its table in batches of changes scores as one of the last state."""
    index = SegmentedIndex.create(spark, fresh_dir(spark, "segments"), "doc_id")
    d, k = t("documents").select("doc_id", "text", F.lit(0).alias("seq")), F.col("doc_id")
    changed = d.withColumn("text", F.concat(F.lit("tion worthless "), F.coalesce("text", F.lit(""))))
    for change, rows in (("A", d.where(k % 5 != 1)), ("A", d.where(k % 5 == 1)), ("M", changed.where(k % 7 == 0)), ("D", d.where(k % 11 == 0))):
        index.apply(rows.withColumn("change", F.lit(change)))
    return S.index_scores(index, asked(spark)).select("query_id", "doc_id", number("score").alias("score"))


@query(BM25 + "select query_id, doc_id, round(score, 6) as score from scored")
def keyword_bm25_scan(spark, t):
    """K4 K5: the same scores without an index, in one pass over the documents."""
    return S.keyword_scores(t("documents"), asked(spark), "doc_id", "text").select("query_id", "doc_id", number("score").alias("score"))


SEARCHED = {1: "tion", 2: "que", 3: "der", 4: "the"}
SQL_SYMBOLS = "list_distinct(ws[1:12])"


def symbol_docs(t):
    """Documents with the first words as their symbols, stored beside the index when first asked for."""
    path = built_once(t.spark, "symbols", t.path("documents"), lambda out: _symbol_docs(t).write.parquet(out))
    return t.spark.read.parquet(path)


def _symbol_docs(t):
    # Each run of letters and digits gives a word or more; the one beyond the twelfth is there for lower case, which looks ahead.
    head = F.regexp_extract("text", r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,13}", 0)
    return t("documents").select("doc_id", "lang", "source", F.array_distinct(F.slice(tokens(head), 1, 12)).alias("symbols"))


@query(BM25.replace(SQL_ASKED, " union all ".join(f"select {q} as query_id, '{x}' as term" for q, x in SEARCHED.items())).rsplit("ranked as", 1)[0].rstrip().rstrip(",") + f""",
d as (select doc_id, {SQL_SYMBOLS} as symbols from w join (select doc_id, lang from documents) using (doc_id) where lang in ('en', 'de')),
f as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from scored join d using (doc_id)),
b as (select query_id, doc_id, score, case when list_contains(symbols, case query_id when 1 then 'tion' when 2 then 'que' when 3 then 'der' else 'the' end) then 3.0 else 1.0 end as boost from f where r <= 20),
o as (select *, row_number() over (partition by query_id order by score * boost desc, doc_id) as rank from b)
select query_id, doc_id, round(score, 6) as bm25_score, cast(boost as double) as boost, round(score * boost, 6) as score, cast(rank as integer) as rank from o where rank <= 10""")
def keyword_search_boosted(spark, t):
    """K6 K8 L2: keyword search in one part of the corpus; twice as many as asked for, then the boost of exact symbols."""
    q = spark.createDataFrame(list(SEARCHED.items()), "query_id int, query string").withColumn("terms", query_terms(F.col("query")))
    found = S.keyword_search(S.index_scores(stored_index(t), q), symbol_docs(t), q, "doc_id", 10, only=F.col("lang").isin("en", "de"))
    return found.select("query_id", "doc_id", number("bm25_score").alias("bm25_score"), "boost", number("score").alias("score"), "rank")


@query(f"with w as (select doc_id, unnest({SQL_TOKENS}) as term from documents) select doc_id, term, count(*) as tf from w group by all")
def postings_table(spark, t):
    """K1: the inverted index."""
    return S.postings(t("documents"), "doc_id", "text").select("doc_id", "term", "tf")


NAMES = ("getUserName", "get_user_name", "parseHTTPResponse", "simple", "A_b_C", "loadXmlFile", "_private", "toString")


@query(f"""
with i as (select p_partkey, {sql_pick(NAMES, 'p_partkey')} as ident from part),
p as (select *, lower(ident) as low, string_split_regex(lower(regexp_replace(ident, '([a-z])([A-Z])', '\\1 \\2', 'g')), '\\s+') as camel, string_split(lower(ident), '_') as snake from i),
v as (select p_partkey, ident, list_concat(list_concat([low], case when len(camel) > 1 then list_append(camel, array_to_string(camel, '_')) else [] end),
  case when len(snake) > 1 then list_append(snake, array_to_string(snake, '')) else [] end) as vs from p)
select p_partkey, ident, array_to_string(list_filter(list_transform(range(1, len(vs) + 1), lambda x: case when list_position(vs, vs[x]) = x then vs[x] else '' end), lambda x: x <> ''), ' ') as variations from v""")
def identifier_variation_list(spark, t):
    """K2 F1: variations of identifiers."""
    ident = pick(NAMES, F.col("p_partkey"))
    return t("part").select("p_partkey", ident.alias("ident"), F.array_join(identifier_variations(ident), " ").alias("variations"))


QUERIES = ("getUserName in auth", 'find "exact phrase" now', "it's 'one' and \"two words\"", "plain words only here", "a.b")


@query(f"""
with q as (select page_id, {sql_pick(QUERIES, 'page_id')} as q from pages)
select page_id, array_to_string(list_transform(regexp_extract_all(q, '"[^"]+"|''[^'']+'''), lambda x: substr(x, 2, length(x) - 2)), '|') as phrases,
 regexp_replace(trim(regexp_replace(q, '"[^"]+"|''[^'']+''', '', 'g')), '\\s+', ' ', 'g') as rest,
 (regexp_matches(q, '[._]') or regexp_matches(q, '[a-z][A-Z]') or regexp_matches(q, '["'']') or len(string_split_regex(q, '\\s+')) <= 3) as wants_keywords from q""")
def query_parts(spark, t):
    """Phrases, the rest of a query, and whether keywords help it."""
    from textquarry.functions.predicates import wants_keywords

    q = pick(QUERIES, F.col("page_id"))
    return t("pages").select("page_id", F.array_join(quoted_phrases(q), "|").alias("phrases"), without_phrases(q).alias("rest"), wants_keywords(q).alias("wants_keywords"))


@query(f"""
with i as (select p_partkey, {sql_pick(NAMES, 'p_partkey')} as ident, string_split(p_name, ' ') as words from part),
p as (select *, lower(ident) as low, string_split_regex(lower(regexp_replace(ident, '([a-z])([A-Z])', '\\1 \\2', 'g')), '\\s+') as camel, string_split(lower(ident), '_') as snake from i),
v as (select p_partkey, list_concat(words, list_concat(list_concat([low], case when len(camel) > 1 then list_append(camel, array_to_string(camel, '_')) else [] end),
  case when len(snake) > 1 then list_append(snake, array_to_string(snake, '')) else [] end)) as vs from p)
select p_partkey, array_to_string(list_filter(list_transform(range(1, len(vs) + 1), lambda x: case when list_position(vs, vs[x]) = x then vs[x] else '' end), lambda x: x <> ''), ' ') as terms from v""")
def or_query_terms(spark, t):
    """K3: all variations of all words of a query."""
    return t("part").select("p_partkey", F.array_join(query_terms(F.concat_ws(" ", "p_name", pick(NAMES, F.col("p_partkey")))), " ").alias("terms"))


@query("""
with s as (select p_partkey, string_split(p_name, ' ') as symbols from part), a as (select *, lower(symbols[1 + p_partkey % len(symbols)]) as asked from s)
select p_partkey, asked, case when list_contains(symbols, asked) then 3.0::double else 1.0::double end as boost from a""")
def symbol_boosts(spark, t):
    """The boost of exact symbols."""
    symbols = F.split("p_name", " ")
    asked_for = F.lower(F.get(symbols, F.pmod(F.col("p_partkey"), F.size(symbols)).cast("int")))
    return t("part").select("p_partkey", asked_for.alias("asked"), S.symbol_boost(asked_for, symbols).alias("boost"))


PHRASE_LIST = {1: ["of", "the"], 2: ["de", "la"], 3: ["the", "and", "of"], 4: ["und", "der"]}


@query("with w as (select doc_id, ' ' || array_to_string(" + SQL_TOKENS + ", '  ') || ' ' as s from documents), p(phrase_id, ph) as (values "
       + ", ".join(f"({k}, ' {'  '.join(v)} ')" for k, v in PHRASE_LIST.items())
       + ") select phrase_id, doc_id, cast((length(s) - length(replace(s, ph, ''))) / length(ph) as bigint) as n from w, p where contains(s, ph)")
def phrase_match(spark, t):
    """K7: adjacency of all words of a phrase."""
    phrases = spark.createDataFrame([(k, v) for k, v in PHRASE_LIST.items()], "phrase_id int, words array<string>")
    return S.phrase_matches(stored_index(t), phrases)


COS = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


@query(f"""with s as (select q.vec_id as query_id, e.vec_id, {COS} as score from embeddings e, embeddings q where q.vec_id in (0, 7, 11)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= 10""")
def vector_knn(spark, t):
    """V1 L1: exact nearest neighbours of three stated queries."""
    e = t("embeddings")
    q = e.where(F.col("vec_id").isin(0, 7, 11)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return S.top_k(S.vector_scores(e, q, "vec_id", "embedding"), 10, key="vec_id").select("query_id", "vec_id", number("score").alias("score"), "rank")


@query(f"""with s as (select q.vec_id as query_id, e.vec_id, {COS} as score from embeddings e, embeddings q where q.vec_id in (0, 7, 11) and e.label = 3),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= 5""")
def vector_knn_filtered(spark, t):
    """The filter comes before the scores; zero padding changes nothing."""
    e = t("embeddings")
    q = e.where(F.col("vec_id").isin(0, 7, 11)).select(F.col("vec_id").alias("query_id"), S.padded(F.col("embedding"), 96).alias("q"))
    part = e.where("label = 3").select("vec_id", S.padded(F.col("embedding"), 96).alias("embedding"))
    return S.top_k(S.vector_scores(part, q, "vec_id", "embedding"), 5, key="vec_id").select("query_id", "vec_id", number("score").alias("score"), "rank")


@query()
def vector_knn_approx(spark, t):
    """V2: stored inverted lists with probes; recall is tested against vector_knn."""
    path = built_once(spark, "lists", t.path("embeddings"), lambda out: S.VectorIndex.write(t("embeddings"), "vec_id", "embedding", out, 10))
    q = t("embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return S.VectorIndex(spark, path, "vec_id", "embedding").search(q, k=10, probes=8)


@query()
def hashed_embeddings(spark, t):
    """V3: lexical embeddings."""
    return S.hashing_embedding(t("documents"), "text", 64).select("doc_id", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query()
def svd_embeddings(spark, t):
    """V3: 384 numbers by the strongest directions of the corpus, padded to 1,536; their length and the first ones."""
    from textquarry.operators.embedding import SvdEmbedder

    made = SvdEmbedder.fit(t("documents"), "text", rounds=8).embed(t("documents"), "text")
    return made.select("doc_id", F.size("embedding").alias("size"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("length"))


@query("""with c as (select distinct sha256(text) as h from documents where doc_id % 2 = 0), d as (select sha256(text) as h from documents where doc_id % 2 = 1)
select h as content_hash, (select count(*) from d where d.h = c.h) as hit_count, false as is_new from c union all select distinct h, cast(0 as bigint), true from d where h not in (select h from c)""")
def embedding_cache_store(spark, t):
    """The cache after a lookup: hits counted up, each distinct miss embedded once and stored."""
    d, now = t("documents"), F.lit("2024-01-02 00:00:00").cast("timestamp")
    old = d.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("content_hash")).distinct()
    cache = old.select("content_hash", F.lit("m").alias("model_name"), F.array(F.lit(0.0).cast("float")).alias("embedding"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_used_at"), F.lit(0).cast("long").alias("hit_count"))
    looked_up = S.cache_lookup(d.where("doc_id % 2 = 1").select("doc_id", "text"), cache, "text", "m")
    kept = S.cache_store(cache, looked_up, "m", lambda missed: S.hashing_embedding(missed.drop("embedding"), "text", 64), now)
    return kept.join(old.withColumn("_o", F.lit(True)), "content_hash", "left").select("content_hash", "hit_count", F.col("_o").isNull().alias("is_new"))


HYBRID = BM25 + f""",
k as (select query_id, doc_id, score, rank from ranked where rank <= 20),
vs as (select v.query_id, e.vec_id as doc_id, {COS.replace('q.embedding', 'v.embedding')} as score from embeddings e, (select cast(vec_id + 1 as integer) as query_id, embedding from embeddings where vec_id in (0, 1, 2, 4)) v),
v as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from vs qualify rank <= 20),
f as (select coalesce(k.query_id, v.query_id) as query_id, coalesce(k.doc_id, v.doc_id) as doc_id, v.score as vs, v.rank as vr, k.rank as kr,
  coalesce(0.6 / (60.0 + v.rank), 0) + coalesce(0.4 / (60.0 + k.rank), 0) as rrf from k full join v on k.query_id = v.query_id and k.doc_id = v.doc_id),
m as (select *, query_id not in (select query_id from k) as fallback_used from f),
o as (select *, case when fallback_used then vs else rrf end as rrf_score from m),
final as (select *, row_number() over (partition by query_id order by rrf_score desc, doc_id) as rank from o)
select query_id, doc_id, cast(vr as integer) as vector_rank, cast(kr as integer) as keyword_rank, round(rrf_score, 6) as rrf_score, fallback_used, cast(rank as integer) as rank from final where rank <= 10"""


@query(HYBRID)
def hybrid_rrf(spark, t):
    """Reciprocal rank fusion of both lists; query 5 has no keyword hits and falls back."""
    e = t("embeddings")
    q = e.where(F.col("vec_id").isin(0, 1, 2, 4)).select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").alias("q"))
    v = S.vector_scores(e.withColumnRenamed("vec_id", "doc_id"), q, "doc_id", "embedding")
    k = S.index_scores(stored_index(t), asked(spark))
    return S.hybrid(v, k, "doc_id", 10).select("query_id", "doc_id", "vector_rank", "keyword_rank", number("rrf_score").alias("rrf_score"), "fallback_used", "rank")


@query(HYBRID.replace("from documents),\nasked", "from documents),\npart_of as (select doc_id from documents where lang = 'en'),\nasked", 1).replace("from scored)", "from scored where doc_id in (select doc_id from part_of))").replace("as score from embeddings e,", "as score from (select * from embeddings where vec_id in (select doc_id from part_of)) e,"))
def hybrid_filtered(spark, t):
    """Hybrid search in one part of the corpus; both lists are filtered before their ranks."""
    e = t("embeddings")
    q = e.where(F.col("vec_id").isin(0, 1, 2, 4)).select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").alias("q"))
    v = S.vector_scores(e.withColumnRenamed("vec_id", "doc_id"), q, "doc_id", "embedding")
    found = S.hybrid(v, S.index_scores(stored_index(t), asked(spark)), "doc_id", 10, only=t("documents").where("lang = 'en'"))
    return found.select("query_id", "doc_id", "vector_rank", "keyword_rank", number("rrf_score").alias("rrf_score"), "fallback_used", "rank")


@query("""
with d as (select 'supplier' as kind, s_suppkey as id, s_name as file, s_nationkey as line from supplier where s_nationkey = 7),
r as (select 'order' as kind, l_orderkey as id, l_returnflag as file, l_linenumber as line from lineitem where l_suppkey in (select id from d)),
b as (select id, file, line, false as is_reexport from d union all select distinct id, file, line, true from r),
o as (select *, row_number() over (order by is_reexport, file, line, id) as position from b)
select id, file, line, is_reexport, cast(position as integer) as position from o where position <= 40""")
def definitions_reexports(spark, t):
    """Definitions, then re-exports, under one limit."""
    d = t("supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("file"), F.col("s_nationkey").alias("line"))
    r = t("lineitem").join(d.select(F.col("id").alias("l_suppkey")), "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    return S.definitions(d, r, F.lit(True), 40)


@query("""select distinct l_orderkey as source, l_returnflag as file, l_linenumber as line from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey = 7)
order by file, line, source limit 50""")
def usages(spark, t):
    """Distinct users of any defining row."""
    edges = t("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"))
    return S.usages(edges, t("supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("id")), 50)


LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)"


@query(f"""select doc_id, cast(line_no as integer) as line_no, cast(length(regexp_extract(line, '^(.*?)token', 1)) + 1 as integer) as "column" from {LINES} where regexp_matches(line, 'token')""")
def grep_lines(spark, t):
    """H5: lines that match, with line and column."""
    return S.grep(t("documents"), "doc_id", "text", "token", fixed=True).select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.col("column").cast("int").alias("column"))


@query(f"select doc_id, cast(line_no as integer) as line_no from {LINES} where regexp_matches(line, '\\b(?:idiot|moron)\\b') order by doc_id, line_no limit 500")
def grep_words(spark, t):
    """H5 H7: whole words."""
    return S.grep(t("documents"), "doc_id", "text", "idiot|moron", 500, word=True).select("doc_id", F.col("line_no").cast("int").alias("line_no"))


def trigram_index(t):
    path = built_once(t.spark, "trigrams", t.path("documents"), lambda out: TrigramIndex.write(t("documents"), "doc_id", "text", out))
    return TrigramIndex(t.spark, path, "doc_id", "text")


PATTERN = "(worth|value)less [a-z]+|idiots? "


@query(f"select doc_id, cast(line_no as integer) as line_no, line from {LINES} where regexp_matches(line, '{PATTERN}') order by doc_id, line_no limit 1000")
def grep_indexed(spark, t):
    """H5 H6 H7: a pattern looked for in the texts that have its trigrams."""
    return trigram_index(t).grep(PATTERN, 1000).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")


@query("select doc_id from documents where regexp_matches(text, 'token') union all select doc_id from documents where regexp_matches(text, ' (?:de la|of the) ')")
def indexed_candidates(spark, t):
    """H5: whole texts by the index, checked by the pattern."""
    index = trigram_index(t)
    return index.texts("token", fixed=True).where(F.col("text").contains("token")).select("doc_id").unionAll(index.texts(" (?:de la|of the) ").where(F.col("text").rlike(" (?:de la|of the) ")).select("doc_id"))


@query(f"""select doc_id, cast(line_no as integer) as line_no, line, (select len(string_split(text, chr(10))) > 4 from documents x where x.doc_id = l.doc_id) as truncated from {LINES} l where line_no between 2 and 4""")
def file_slices(spark, t):
    """Three lines from the second."""
    return S.file_slice(t("documents"), "doc_id", "text", 2, 3)


CODE = ("export function alpha(x) {\n  return beta(x)\n}", "const v = alpha(1)\nalpha(v)", "class Gamma {\n  run() { alpha() }\n}", "import { alpha } from './a'\nlet q = 3", "// alpha is old\ndef alpha(a):\n    pass")


SQL_CODE = f"(select n_nationkey as id, unnest(string_split(code, '~')) as line, generate_subscripts(string_split(code, '~'), 1) as line_no from (select n_nationkey, {sql_pick([c.replace(chr(10), '~') for c in CODE], 'n_nationkey')} as code from nation))"
DEFINES = r"\b(function|class|interface|type|enum|const|let|var|def|fn|func|struct|trait)\b.{0,80}\balpha\b"


def code(t):
    return t("nation").select(F.col("n_nationkey").alias("id"), pick(CODE, F.col("n_nationkey")).alias("code"))


@query(f"select id, cast(line_no as integer) as line_no, line from {SQL_CODE} where regexp_matches(line, '{DEFINES}') order by id, line_no limit 50")
def regex_definitions(spark, t):
    """H6: lines that define a symbol."""
    return S.definition_lines(code(t), "id", "code", "alpha", 50).select("id", F.col("line_no").cast("int").alias("line_no"), "line")


@query(f"with h as (select * from {SQL_CODE} where regexp_matches(line, '\\balpha\\b') order by id, line_no limit 100) select id, cast(line_no as integer) as line_no, line from h where not regexp_matches(line, '{DEFINES}') order by id, line_no limit 50")
def regex_usages(spark, t):
    """H7: lines that use a symbol and do not define it."""
    return S.usage_lines(code(t), "id", "code", "alpha").select("id", F.col("line_no").cast("int").alias("line_no"), "line")


FILE_CODE = ("import {{ x }} from './a'", "const y = require('../lib/a.js')", "import './a.tsx'", "from pkg.a import z", "from './ab'", "no import of a", "from x import a")


@query(f"""with f as (select page_id, 'src/f' || page_id || case when page_id % 11 = 0 then '.pem' else '.ts' end as file, {sql_pick(FILE_CODE, 'page_id')} as content from pages),
h as (select file from f where not ends_with(file, '.pem') and regexp_matches(content, 'from [''"][^''"]*a(\\.[jt]sx?)?[''"]|require\\([''"][^''"]*a(\\.[jt]sx?)?[''"]\\)|import [''"][^''"]*a(\\.[jt]sx?)?[''"]|from \\S*a import'))
select array_to_string(list_sort(list(file)), ',') as importers, cast(count(*) as integer) as n, count(*) >= 5 as high_impact, true as partial from h""")
def regex_importers(spark, t):
    """H8: importers by the four forms of an import, without secrets; high impact from five."""
    ending = F.when(F.col("page_id") % 11 == 0, ".pem").otherwise(".ts")
    files = t("pages").select(F.concat(F.lit("src/f"), F.col("page_id").cast("string"), ending).alias("file"), pick(FILE_CODE, F.col("page_id")).alias("content"))
    return S.importers_by_text(files, "src/a.ts").withColumn("importers", F.array_join("importers", ","))


@query("""
with h as (select doc_id, sha256(text) as content_hash, row_number() over (partition by text order by doc_id) as r from documents)
select doc_id, content_hash, r > 1 as hit from h""")
def content_hash_cache(spark, t):
    """A text that came before is a hit."""
    from pyspark.sql import Window

    h = t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, "content_hash").select("doc_id", "content_hash", (F.col("doc_id") > F.col("first")).alias("hit"))


@query("""with c as (select text, count(*) as n from documents where doc_id % 2 = 0 group by text), d as (select doc_id, text from documents where doc_id % 2 = 1)
select count(*) as lookups, count(c.text) as hits, count(*) - count(c.text) as misses, round(coalesce(count(c.text) / nullif(count(*), 0), 0), 6) as hit_rate from d left join c using (text)""")
def cache_hit_rate(spark, t):
    """Lookups of odd documents in a cache of the even ones."""
    d = t("documents")
    cache = d.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("content_hash")).distinct().withColumn("model_name", F.lit("m")).withColumn("embedding", F.array(F.lit(0.0)))
    r = S.cache_lookup(d.where("doc_id % 2 = 1").select("doc_id", "text"), cache, "text", "m")
    return r.agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("hit_rate", number(F.coalesce(F.try_divide("hits", "lookups"), F.lit(0.0))))


@query("select doc_id, text as content, lang from documents where source = 'src3' and lang = 'en'")
def table_slice(spark, t):
    """A slice by two equality filters, pushed to the scan."""
    from textquarry.sources.files import table_slice as cut_out

    return cut_out(t("documents").select("doc_id", F.col("text").alias("content"), "lang", "source"), "src3", "en", "source", "lang").drop("source")


@query("""with r as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rank, count(*) over (partition by source) as c from documents) select source, doc_id, n_chars, cast(rank as integer) as rank, cast(greatest(0, c - 3) as integer) as removed from r where rank <= 3""")
def per_group_topn(spark, t):
    """Three per file, and how many more there were."""
    return top_per_group(t("documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 3, removed=True)


@query(f"select doc_id, cast(len(ws) as bigint) as n_tokens, cast(len(list_distinct(ws)) as bigint) as n_distinct from (select doc_id, {SQL_TOKENS} as ws from documents)")
def token_counts(spark, t):
    """K1: tokens and distinct tokens."""
    ws = tokens(F.col("text"))
    return t("documents").select("doc_id", long(F.size(ws)).alias("n_tokens"), long(F.size(F.array_distinct(ws))).alias("n_distinct"))
