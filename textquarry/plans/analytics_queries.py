"""Queries of the aggregate, window, set and join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import predicates as P
from textquarry.functions import text as X
from textquarry.operators import findings as FN
from textquarry.operators import windows as WN
from textquarry.plans.registry import long, number, pick, query, sql_list, sql_pick
from textquarry.plans.shared import SQL_CHUNKS, located, sql_likeness

SEV = "case when value >= 75 then 'CRITICAL' when value >= 50 then 'HIGH' when value >= 25 then 'MEDIUM' else 'LOW' end"
STATUS = "case event_id % 5 when 0 then 'open' when 1 then 'fixed' when 2 then 'uncertain' when 3 then 'wont-fix' else 'false-positive' end"
EVENTS = f"(select *, {SEV} as severity, {STATUS} as status, user_id as feature from events)"


def as_findings(t):
    return t("events").withColumn("severity", F.expr(SEV)).withColumn("status", F.expr(STATUS)).withColumn("feature", F.col("user_id"))


@query("select count(*) as chunks, count(distinct source) as files, case when count(*) > 0 then 'indexed' else 'empty' end as status from documents where lang = 'en'")
def repo_stats(spark, t):
    """A1."""
    return t("documents").where("lang = 'en'").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"), F.when(F.count("*") > 0, "indexed").otherwise("empty").alias("status"))


@query("""with b as (select source, lang, count(*) as chunks, count(distinct n_chars) as files from documents group by all)
select source, string_agg(lang, ',' order by lang) as branches, cast(sum(chunks) as bigint) as chunks, cast(sum(files) as bigint) as files from b group by source""")
def repo_rollup(spark, t):
    """A2: per branch, then per repository; distinct files of branches are summed."""
    b = t("documents").groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.count_distinct("n_chars").alias("files"))
    return b.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("branches"), F.sum("chunks").alias("chunks"), F.sum("files").alias("files"))


@query("""select source, string_agg(distinct lang, ',' order by lang) as langs from documents group by source""")
def distinct_arrays(spark, t):
    """A4 O2: distinct values per file."""
    return t("documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("select coalesce(lang, 'unknown') as lang, count(*) as n from documents group by 1 order by n desc, lang")
def type_distribution(spark, t):
    """A5."""
    return t("documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("""select count(*) as total, count(*) filter (length(text) > 100) as long_texts, count(*) filter (n_chars > 1000) as over_1000, count(*) filter (lang is null) as no_lang,
count(*) filter (length(text) <> n_chars) as wrong_size from documents""")
def quality_counts(spark, t):
    """Conditional counts in one pass."""
    return t("documents").agg(
        F.count("*").alias("total"), F.count_if(F.length("text") > 100).alias("long_texts"), F.count_if(F.col("n_chars") > 1000).alias("over_1000"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.length("text") != F.col("n_chars")).alias("wrong_size")
    )


@query("select count(*) as edges, count(distinct (l_orderkey, l_partkey, l_returnflag)) as distinct_edges, count(distinct l_returnflag) as types from lineitem")
def composite_distinct(spark, t):
    """A7."""
    return t("lineitem").agg(F.count("*").alias("edges"), F.count_distinct(F.struct("l_orderkey", "l_partkey", "l_returnflag")).alias("distinct_edges"), F.count_distinct("l_returnflag").alias("types"))


@query("select count(*) as entries, count(distinct event_type) as models, round(sum(value), 2) as hits, min(event_id) as first_id, max(event_id) as last_id from events")
def cache_table_stats(spark, t):
    """A8."""
    return t("events").agg(F.count("*").alias("entries"), F.count_distinct("event_type").alias("models"), number(F.sum("value"), 2).alias("hits"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


SEVERITY_COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as {s.lower()}" for s in FN.SEVERITIES)


@query(f"select status, {SEVERITY_COUNTS}, count(*) as total from {EVENTS} group by status")
def severity_rollup(spark, t):
    """Severities by status, zero-filled."""
    return FN.severity_rollup(as_findings(t), "severity", ["status"])


@query(f"select feature, {SEVERITY_COUNTS}, count(*) as total from {EVENTS} where status in ('open', 'uncertain') group by feature order by critical desc, high desc, total desc, feature")
def feature_severity(spark, t):
    """Feature by severity, worst first."""
    return FN.severity_rollup(as_findings(t).where(P.is_unresolved(F.col("status"))), "severity", ["feature"]).orderBy(F.desc("critical"), F.desc("high"), F.desc("total"), "feature")


@query(f"select count(*) as total, count(*) filter (status = 'open') as open, count(*) filter (status = 'uncertain') as uncertain, count(*) filter (status not in ('open', 'uncertain')) as closed from {EVENTS}")
def report_header(spark, t):
    """A13."""
    f = as_findings(t)
    return f.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "uncertain").alias("uncertain"), F.count_if(~P.is_unresolved(F.col("status"))).alias("closed"))


@query("select conv_id, cast(sum(length(text)) as bigint) as tokens, cast(sum(turn) as bigint) as turns, count(*) as messages from conversations where role = 'assistant' group by conv_id")
def usage_by_conversation(spark, t):
    """A14."""
    m = t("conversations").select("conv_id", "role", F.length("text").cast("long").alias("tokens"), F.col("turn").alias("turns"))
    return FN.usage_totals(m, "role", ["tokens", "turns"], ["conv_id"])


@query("""with u as (select sum(length(text)) as n, count(*) as m from conversations where role = 'assistant')
select cast(n as bigint) as tokens, m as messages, case when n < 1000 then cast(n as varchar) when n < 1000000 then printf('%.1fk', n / 1000.0) else printf('%.2fM', n / 1e6) end as shown from u""")
def usage_total(spark, t):
    """One sum, and how it is shown."""
    m = t("conversations").select("role", F.length("text").cast("long").alias("tokens"))
    return FN.usage_totals(m, "role", ["tokens"]).withColumn("shown", X.human_tokens(F.col("tokens")))


@query(f"""select feature, count(*) as findings, cast(count(*) filter (status = 'fixed') as bigint) as done, (array_agg(event_id order by ts, event_id) filter (status = 'wont-fix'))[1] as first_abort from {EVENTS} group by feature""")
def audit_tally(spark, t):
    """Sums, and the first of the aborted by time."""
    f = as_findings(t)
    return f.groupBy("feature").agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "fixed").alias("done"), F.min(F.when(F.col("status") == "wont-fix", F.struct("ts", "event_id")))["event_id"].alias("first_abort"))


FAIL_ON = ("none", "critical", "high")


@query(f"""with c as (select feature, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high from {EVENTS} where status = 'open' group by feature),
g as (select *, {sql_pick(FAIL_ON, 'feature')} as fail_on from c)
select feature, fail_on, case when (fail_on = 'critical' and critical > 0) or (fail_on = 'high' and (critical > 0 or high > 0)) then 1 else 0 end as exit_code,
case when critical > 0 or high > 0 then 'NEEDS_DISCUSSION' else 'APPROVE' end as verdict from g""")
def ci_gate(spark, t):
    """Exit code by policy, and the verdict that counts allow."""
    c = FN.severity_rollup(as_findings(t).where("status = 'open'"), "severity", ["feature"]).withColumn("fail_on", pick(FAIL_ON, F.col("feature")))
    return c.select("feature", "fail_on", P.ci_exit_code(F.col("critical"), F.col("high"), F.col("fail_on")).alias("exit_code"), FN.verdict_for_approval(F.lit("APPROVE"), F.col("critical"), F.col("high")).alias("verdict"))


@query(f"""with g as (select event_type as persona, max(case when severity in ('CRITICAL', 'HIGH') then 1 else 0 end) as e from {EVENTS} where status = 'open' group by 1) select max(e) as exit_code, count(*) as reviewers from g""")
def ci_gate_reviewers(spark, t):
    """The greatest exit code of several reviewers."""
    f = as_findings(t).where("status = 'open'")
    return f.groupBy("event_type").agg(F.max(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 1).otherwise(0)).alias("e")).agg(F.max("e").alias("exit_code"), F.count("*").alias("reviewers"))


@query(f"select feature, event_type as persona, count(*) as n, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from {EVENTS} where status = 'open' group by all")
def group_feature_persona(spark, t):
    """A18."""
    f = as_findings(t).where("status = 'open'")
    return f.groupBy("feature", F.col("event_type").alias("persona")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("""with s as (select doc_id, case when doc_id % 3 = 0 then ['vector', 'keyword'] when doc_id % 3 = 1 then ['vector'] else ['usage', 'definition'] end as sources from documents)
select unnest(sources) as source, count(*) as n from s group by 1""")
def source_breakdown(spark, t):
    """Results by source."""
    s = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("vector"), F.lit("keyword"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("vector"))).otherwise(F.array(F.lit("usage"), F.lit("definition")))
    return t("documents").select(F.explode(s).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("with s as (select unnest(string_split(p_name, ' ')) as symbol, p_partkey from part) select symbol, count(*) as n, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as chunks from s group by symbol")
def symbol_index(spark, t):
    """A22."""
    s = t("part").select(F.explode(F.split("p_name", " ")).alias("symbol"), "p_partkey")
    return s.groupBy("symbol").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("chunks"))


@query("select distinct l_orderkey as src, l_partkey as dst from lineitem where l_orderkey <> l_partkey")
def edge_dedupe(spark, t):
    """No loops, no repeats."""
    return t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).where("src <> dst").dropDuplicates(["src", "dst"])


@query(f"""with s as (select feature, count(*) filter (severity = 'CRITICAL') as structured from {EVENTS} group by feature), p as (select feature, case when feature % 4 = 0 then null else feature % 7 end as parsed from s)
select feature, coalesce(case when feature % 3 = 0 then null else structured end, parsed) as critical, coalesce((case when feature % 3 = 0 then null else structured end) <> parsed, false) as mismatch from s join p using (feature)""")
def summary_counts(spark, t):
    """Structured counts before parsed ones, and whether they differ."""
    s = as_findings(t).groupBy("feature").agg(F.count_if(F.col("severity") == "CRITICAL").alias("n"))
    structured, parsed = F.when(F.col("feature") % 3 != 0, F.col("n")), F.when(F.col("feature") % 4 != 0, F.col("feature") % 7)
    return s.select("feature", F.coalesce(structured, parsed).alias("critical"), F.coalesce(structured != parsed, F.lit(False)).alias("mismatch"))


@query("""with c as (select doc_id, case when doc_id % 11 = 0 then 'modified' when doc_id % 7 = 0 then 'test' when contains(lower(text), 'type ') or contains(lower(text), 'class ') then 'type_definition' else 'similar' end as section from documents)
select section, count(*) as n, min(doc_id) as first_id from c group by section""")
def section_groups(spark, t):
    """Chunks by section type."""
    c = t("documents").select("doc_id", P.chunk_category(F.col("doc_id") % 11 == 0, F.col("doc_id") % 7 == 0, F.lit(False), F.col("text")).alias("section"))
    return c.groupBy("section").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


JOBS = """(select event_id as id, cast(user_id as varchar) as repo, case user_id % 2 when 0 then 'main' else 'dev' end as branch, cast(value * 10 as integer) as file_count, ts as enqueued_at,
 case event_type when 'view' then 'pending' when 'click' then 'processing' when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end as status,
 case when value * 10 > 500 then 'low' when event_id % 2 = 0 then 'high' else 'normal' end as priority from events)"""


def jobs(t):
    return t("events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("repo"), F.when(F.col("user_id") % 2 == 0, "main").otherwise("dev").alias("branch"), F.round(F.col("value") * 10).cast("int").alias("file_count"), F.col("ts").alias("enqueued_at"),
        F.when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"),
        F.when(F.col("value") * 10 > 500, "low").when(F.col("event_id") % 2 == 0, "high").otherwise("normal").alias("priority"),
    )


@query(f"select status, count(*) as n from {JOBS} group by status")
def queue_counts(spark, t):
    """A27."""
    return jobs(t).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""with r as (select *, row_number() over (partition by branch order by case priority when 'high' then 0 when 'normal' then 1 else 2 end, enqueued_at, id) as rn from {JOBS} where status = 'pending') select branch, id, priority from r where rn <= 3""")
def priority_queue_next(spark, t):
    """W9 ST2 ST3: the next jobs of each branch."""
    from textquarry.streaming.state import next_jobs

    return next_jobs(jobs(t), 3, ["branch"]).select("branch", "id", "priority")


@query(f"""select count(*) as new_jobs, count(*) filter (where (repo, branch) not in (select (repo, branch) from {JOBS} where status in ('pending', 'processing') and id < 500)) as admitted from {JOBS} where id >= 500""")
def queue_admission(spark, t):
    """ST2: no second job for a repository and branch with an active one."""
    from textquarry.streaming.state import admissible_jobs

    j = jobs(t)
    new = j.where("id >= 500")
    return new.agg(F.count("*").alias("new_jobs")).crossJoin(admissible_jobs(new, j.where("id < 500")).agg(F.count("*").alias("admitted")))  # one row each


TOKENS = "cast(ceil(length(text) / 4.0) as bigint) + 50"


@query(f"""with s as (select doc_id, source, n_chars, sum({TOKENS}) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) as used from documents) select source, doc_id, cast(used as bigint) as used from s where used <= 4000""")
def token_budget_pack(spark, t):
    """The longest prefix of each source's documents that fits."""
    d = t("documents").select("source", "doc_id", "n_chars", long(WN.estimated_tokens(F.col("text"))).alias("cost"))
    return WN.token_budget(d, F.col("cost"), [F.desc("n_chars"), F.col("doc_id")], 4000, by=["source"]).select("source", "doc_id", long("used").alias("used"))


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc, role) = 1")
def dedupe_last(spark, t):
    """The last turn of each conversation."""
    return WN.keep_last(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], F.desc("turn"), F.col("role"))


@query("""with r as (select user_id, cast(epoch(ts) / 3600 as bigint) as a, cast(epoch(ts) / 3600 as bigint) + cast(floor(value) as bigint) % 20 as b from events),
m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as reach from r)
select user_id, reach + 1 as gap_start, a - 1 as gap_end from m where a > reach + 1""")
def coverage_gaps(spark, t):
    """Stretches that no range covers."""
    hours = F.round(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    hours = F.expr("cast(round(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 3600000000.0) as long)")
    r = t("events").select("user_id", hours.alias("a"), (hours + F.floor("value").cast("long") % 20).alias("b"))
    return WN.coverage_gaps(r, "user_id", "a", "b")


BLOCKS = ("```findings\n1\n```\ntext\n```findings\n2\n```", "none", "```findings\n3\n```", "```other\n4\n```\n```findings\n5\n```")


@query(f"with b as (select n_nationkey as id, {sql_pick([b.replace(chr(10), '~') for b in BLOCKS], 'n_nationkey')} as s from nation) select id, list_extract(regexp_extract_all(s, '```findings~(.*?)~```', 1), -1) as body from b")
def last_fence(spark, t):
    """The last block with the tag."""
    return t("nation").select(F.col("n_nationkey").alias("id"), FN.last_block(pick(BLOCKS, F.col("n_nationkey")), "findings").alias("body"))


def _likeness_sql() -> str:
    return f"""with c as {SQL_CHUNKS}, l as (select *, lag(doc_id) over (partition by lang order by doc_id) as before from c), s as (select l.lang, l.file, {sql_likeness('p', 'l')} as s, before from l left join c p on p.doc_id = l.before)
select lang, count(*) as results, count(distinct file) as files, round(avg(case when before is not null then s end), 6) as avg_similarity from s group by lang"""


@query(_likeness_sql())
def consecutive_similarity(spark, t):
    """Likeness of neighbours in a list by words, path and lines, and its mean."""
    from textquarry.operators.similarity import likeness_of, similarity_tokens

    s = WN.similarity_to_previous(located(t), "lang", F.col("doc_id"), likeness_of, {"code": similarity_tokens(F.col("code"))})
    return s.groupBy("lang").agg(F.count("*").alias("results"), F.count_distinct("file").alias("files"), number(F.avg("similarity")).alias("avg_similarity"))


@query("""with f as (select event_id, event_type, value from events order by value desc, event_id limit 40) select event_id, event_type, value, round(value * case event_type when 'view' then 2.1 when 'click' then 3.0 else 1.0 end, 6)::double as score from f order by score desc, event_id limit 20""")
def overfetch_rerank(spark, t):
    """L2: twice as many by one score, then the best by another."""
    first = t("events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(40)
    score = number(F.col("value") * F.when(F.col("event_type") == "view", 2.1).when(F.col("event_type") == "click", 3.0).otherwise(1.0))
    return first.withColumn("score", score).orderBy(F.desc("score"), "event_id").limit(20)


NAMES = ("parse", "a.b", "renderView", "x y", "it", "get_name", "Foo::bar")


@query(f"""with q as (select distinct {sql_pick(NAMES, 'p_partkey')} as q from part) select q, cast(row_number() over (order by case when regexp_matches(q, '^[A-Za-z_$][A-Za-z0-9_$]*$') then 0 else 1 end, length(q), q) as integer) as position from q order by position limit 5""")
def query_order(spark, t):
    """Identifiers first, then the shorter, five at most."""
    from pyspark.sql import Window

    q = t("part").select(pick(NAMES, F.col("p_partkey")).alias("q")).distinct()
    order = [F.when(F.col("q").rlike(r"^[A-Za-z_$][\w$]*$"), 0).otherwise(1), F.length("q"), F.col("q")]
    return q.orderBy(*order).limit(5).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("int"))


@query(f"""select event_id, severity from {EVENTS} where status = 'open' order by case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, event_id limit 10""")
def first_issues(spark, t):
    """The first ten open findings by severity."""
    return as_findings(t).where(F.col("status").isin("open")).orderBy(P.severity_order(F.col("severity")), "event_id").limit(10).select("event_id", "severity")


#: How many findings, and owned, context and cited files, a feature shows.
CAPS = {"findings": 10, "owned": 12, "context": 24, "cited": 24}


@query("""with k as (select source, doc_id, n_chars, ['findings', 'owned', 'context', 'cited'][doc_id % 4 + 1] as kind from documents union all select 'all', doc_id, n_chars, ['findings', 'owned', 'context', 'cited'][doc_id % 4 + 1] from documents),
r as (select *, row_number() over (partition by source, kind order by n_chars, doc_id) as r from k) select source, kind, doc_id from r where r <= case kind when 'findings' then 10 when 'owned' then 12 else 24 end""")
def feature_caps(spark, t):
    """The first findings and owned, context and cited files of each feature."""
    d = t("documents").select("source", "doc_id", "n_chars", pick(tuple(CAPS), F.col("doc_id")).alias("kind"))
    rows = d.unionByName(d.withColumn("source", F.lit("all")))
    cap = F.lit(0)
    for kind, n in CAPS.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return rows.withColumn("r", F.expr("row_number() over (partition by source, kind order by n_chars, doc_id)")).where(F.col("r") <= cap).select("source", "kind", "doc_id")


@query("""with u as (select doc_id, source, 0 as part from documents where doc_id % 3 = 0 union all select doc_id, source || 'x', 1 from documents where doc_id % 2 = 0)
select doc_id, source, part from u qualify row_number() over (partition by doc_id order by part) = 1""")
def first_wins_union(spark, t):
    """O1: concatenation in which the first part's row stays."""
    d = t("documents")
    return WN.first_wins([d.where("doc_id % 3 = 0").select("doc_id", "source"), d.where("doc_id % 2 = 0").select("doc_id", F.concat("source", F.lit("x")).alias("source"))], ["doc_id"], ["source"])


@query("""select lower(q) as q, min(pos) as pos from (select event_type as q, 0 as pos from events union all select upper(event_type), 1 from events union all select 'Extra', 2) group by 1""")
def merged_queries(spark, t):
    """Lists merged without regard to case; the first place stays."""
    e = t("events").select(F.col("event_type").alias("q")).distinct()
    both = e.withColumn("pos", F.lit(0)).unionByName(e.select(F.upper("q").alias("q"), F.lit(1).alias("pos"))).unionByName(spark.createDataFrame([("Extra", 2)], "q string, pos int"))
    return both.groupBy(F.lower("q").alias("q")).agg(F.min("pos").alias("pos"))


@query("select 'orders' as origin, o_orderkey as id, 'ok' as status from orders where o_orderstatus = 'F' union all select 'customer', c_custkey, case when c_acctbal < 0 then 'error' else 'ok' end from customer")
def isolated_union(spark, t):
    """Two sources, errors as a status."""
    a = t("orders").where("o_orderstatus = 'F'").select(F.lit("orders").alias("origin"), F.col("o_orderkey").alias("id"), F.lit("ok").alias("status"))
    return a.unionByName(t("customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "error").otherwise("ok").alias("status")))


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)")
def semi_join(spark, t):
    """Rows whose key is in a set, as a semi join."""
    return t("lineitem").join(t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""with f as (select source, list(doc_id) as owned, count(*) as n from documents group by source) select source as feature_id, n from f where list_has_any(owned, (select list(doc_id) from documents where doc_id % 37 = 5))""")
def touched_feature_list(spark, t):
    """Features that own a touched file."""
    d = t("documents")
    features = d.groupBy(F.col("source").alias("feature_id")).agg(F.collect_list("doc_id").alias("owned"))
    touched = d.where("doc_id % 37 = 5").select(F.col("doc_id").alias("file"))
    return FN.touched_features(features, touched).select("feature_id", long(F.size("owned")).alias("n"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 7 = 0)")
def anti_join(spark, t):
    """Features that have no findings yet."""
    found = t("orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(found, "c_custkey", "left_anti")


@query("""with r as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1, 5)) as a from documents), l as (select distinct doc_id, 1 + (doc_id * 7 + i) % 20 as line from documents, range(3) x(i) where doc_id % 4 = 0)
select distinct doc_id, a as start_line, a + 4 as end_line from r join l using (doc_id) where line between a and a + 4""")
def range_overlap(spark, t):
    """Chunks that hold a changed line: an equi-join on the file with a range condition."""
    d = t("documents")
    r = d.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.size(F.split("text", "\n")).cast("long"), F.lit(5).cast("long"))).alias("start_line")).withColumn("end_line", F.col("start_line") + 4)
    n = d.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(*[1 + (F.col("doc_id") * 7 + i) % 20 for i in range(3)])).alias("line")).distinct()
    return r.join(n, (r.doc_id == n.doc_id) & P.overlaps(F.col("start_line"), F.col("end_line"), F.col("line")), "left_semi")


@query("""select user_id as title, coalesce(max(event_id) filter (event_type = 'view'), max(event_id) filter (event_type = 'click')) as kept, max(event_id) filter (event_type = 'view') is not null as fresh from events where event_type in ('click', 'view') and (event_type = 'click' or user_id % 3 > 0) group by 1""")
def title_merge(spark, t):
    """W5 ST11: of equal titles a fresh finding wins over a prior one, then the last."""
    e = t("events").select(F.col("user_id").alias("title"), F.col("event_id").alias("seq"), "event_type")
    merged = FN.merge_by_title(e.where("event_type = 'click'"), e.where("event_type = 'view' and title % 3 > 0"))
    return merged.select("title", F.col("seq").alias("kept"), (F.col("is_fresh") == 1).alias("fresh"))


@query("""select user_id as title, count(*) as n from events where event_type = 'view' and (user_id in (select user_id from events where event_type = 'error' and value > 50) or user_id not in (select user_id from events where event_type = 'error')) group by 1""")
def surviving_findings(spark, t):
    """Prior findings that are still present or that no verdict names."""
    e = t("events")
    prior = e.where("event_type = 'view'").select(F.col("user_id").alias("title"), "event_id")
    bad = e.where("event_type = 'error'")
    verdicts = bad.groupBy(F.col("user_id").alias("title")).agg(F.when(F.max("value") > 50, "still-present").otherwise("fixed").alias("verdict"))
    return FN.surviving(prior, verdicts).groupBy("title").agg(F.count("*").alias("n"))


@query(f"""with v as (select user_id as f, case max(event_type) when 'view' then 'fixed' when 'signup' then 'uncertain' else 'still-present' end as verdict from events where event_id % 3 = 0 group by 1),
f as (select distinct event_id as finding_id, status, feature, ['general', 'security'][event_id % 2 + 1] as persona from {EVENTS}),
s as (select finding_id, feature, persona, case verdict when 'fixed' then 'fixed' when 'still-present' then 'open' when 'uncertain' then 'uncertain' else status end as status from f left join v on f.feature = v.f)
select finding_id, case when feature % 7 = 0 and persona = 'security' and status in ('open', 'uncertain') then 'uncertain' else status end as status from s""")
def lifecycle(spark, t):
    """J17 ST10: verdicts become statuses; without one nothing changes, but what lost its feature or persona is uncertain."""
    e = t("events")
    v = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("feature")).agg(F.max("event_type").alias("m")).select("feature", F.when(F.col("m") == "view", "fixed").when(F.col("m") == "signup", "uncertain").otherwise("still-present").alias("verdict"))
    f = as_findings(t).select(F.col("event_id").alias("finding_id"), "status", "feature", pick(("general", "security"), F.col("event_id")).alias("persona"))
    by_id = f.join(v, "feature").select("finding_id", "verdict")
    gone = f.where("feature % 7 = 0").select("feature", F.lit("security").alias("persona"))
    return FN.latest_statuses(f, by_id, gone).select("finding_id", "status")


@query("""with c as (select source, count(*) as n from documents group by source union all select lang, count(*) from documents group by lang union all select 'all', count(*) from documents)
select source, n, n > 100 as background, case when n > 500 then 'low' when n % 2 = 0 then 'high' else 'normal' end as priority from c""")
def background_rule(spark, t):
    """ST3: what is indexed in the background, and with which priority."""
    from textquarry.streaming.state import goes_to_background, job_priority

    d = t("documents")
    c = d.groupBy("source").agg(F.count("*").alias("n")).unionByName(d.groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("n"))).unionByName(d.agg(F.count("*").alias("n")).withColumn("source", F.lit("all")))
    return c.select("source", "n", goes_to_background(F.col("n")).alias("background"), job_priority(F.col("n"), F.when(F.col("n") % 2 == 0, "high")).alias("priority"))


PATHS = (
    "src/api/users.ts", "src/auth/login.ts", "config/.env", "config/.env.example", "lib/db/schema.sql", "src/__tests__/a.ts", "tests/test_x.py", "keys/server.PEM", "home/.ssh/id_rsa", "src/client/sdk.go",
    "src/token.rs", "app/application-prod.yml", "src/parser/json.java", "docs/readme.md", "node_modules/x/index.js", "src/storage/disk.cpp", "my-service-account.json", "src/route.tsx", "a/b/webhooks/c.py", "package.json", "tsconfig.build.json", "pkg/permission/x.cs",
)
SQL_PATH = sql_pick(PATHS, "page_id")


def paths(t):
    return t("pages").select("page_id", pick(PATHS, F.col("page_id")).alias("path"))


SQL_PARTS = "string_split(lower(path), '/')"
BAD = (
    f"list_contains({sql_list(P.SENSITIVE_PARTS)}, p) or starts_with(p, '.env.') or regexp_matches(p, '{P.PROFILE_FILE}') or (not ends_with(p, '.pub') and regexp_matches(p, '\\.(pem|key|p12|pfx|crt|cer)$')) or list_contains({sql_list(P.KEY_NAMES)}, p)"
    f" or regexp_matches(p, '{P.ACCOUNT_FILE}') or regexp_matches(p, '{P.CREDENTIAL_FILE}')"
)
SQL_LANGUAGE = "case " + " ".join(f"when regexp_matches(lower(path), '\\{e}$') then '{g}'" for e, g in P.LANGUAGES.items()) + " end"


@query(f"""with x as (select page_id, {SQL_PATH} as path from pages)
select page_id, path, {SQL_LANGUAGE} as language, ({SQL_LANGUAGE}) is not null and not list_has_any(string_split(path, '/'), {sql_list(P.EXCLUDED_FOLDERS)}) as indexable,
len(list_filter({SQL_PARTS}, lambda p: not list_contains({sql_list(P.SAFE_PARTS)}, p) and ({BAD}))) > 0 as sensitive,
regexp_matches(path, '{P.TEST_FOLDERS}') or regexp_matches(path, '{P.TEST_NAMES}') or regexp_matches(path, '(^|/)test_[^/]*$') as is_test from x""")
def path_predicates(spark, t):
    """Language, indexing, secrets and tests by path."""
    p = F.col("path")
    return paths(t).select("page_id", "path", P.language_of(p).alias("language"), P.is_indexable(p).alias("indexable"), P.is_sensitive(p).alias("sensitive"), P.is_test_file(p).alias("is_test"))


TAGS = " , ".join(f"case when regexp_matches(path, '{r}') then {sql_list(ts)} else [] end" for r, ts in P.BOUNDARY_RULES)


@query(f"""with x as (select page_id, {SQL_PATH} as path from pages) select page_id, array_to_string(list_sort(list_distinct(flatten([{TAGS}]))), ',') as tags from x""")
def trust_tags(spark, t):
    """Trust boundaries of a path."""
    return paths(t).select("page_id", F.array_join(P.trust_boundaries(F.col("path")), ",").alias("tags"))


@query(f"""with x as (select page_id, {SQL_PATH} as path from pages), y as (select page_id, unnest(list_distinct(flatten([{TAGS}]))) as tag from x) select tag, count(*) as n, min(page_id) as first_page from y group by tag""")
def trust_summary(spark, t):
    """Files by boundary."""
    return paths(t).select("page_id", F.explode(P.trust_boundaries(F.col("path"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


KINDS = ("library", "service", "test-suite", "route")


@query(f"""with x as (select page_id, {SQL_PATH} as path, {sql_pick(KINDS, 'page_id')} as kind from pages), y as (select *, flatten([{TAGS}]) as tags from x)
select page_id, 'general' || case when kind in ('library', 'service') then ',architect' else '' end || case when list_has_any(tags, {sql_list(P.SECURITY_BOUNDARIES)}) then ',security' else '' end || case when kind = 'test-suite' or page_id % 5 = 0 then ',test-auditor' else '' end as personas from y""")
def persona_dispatch(spark, t):
    """Reviewers by kind and boundaries."""
    return paths(t).select("page_id", F.array_join(P.personas(pick(KINDS, F.col("page_id")), P.trust_boundaries(F.col("path")), F.col("page_id") % 5 == 0), ",").alias("personas"))


@query(f"""with x as (select page_id, regexp_extract({SQL_PATH}, '[^/]*$') as name from pages) select page_id, case when regexp_matches(name, '^tsconfig.*\\.json$') then 'tsconfig' when name = 'package.json' then 'package_json' end as kind from x""")
def config_files(spark, t):
    """P10: configuration files by name."""
    return paths(t).select("page_id", P.config_type(F.col("path")).alias("kind"))


@query("""select event_id, coalesce(json_extract_string(props, '$.k'), '') as k, coalesce(contains(lower(props), 'dynamic'), false) as dynamic, event_type in ('error', 'signup') as pending from events""")
def json_flags(spark, t):
    """JSON fields and flags."""
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), P.is_dynamic(F.col("props")).alias("dynamic"), P.is_pending(F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "pending").otherwise("done")).alias("pending"))


SYMBOLS = ("getUser", "UserName", "id", "parse_all", "GetThing", "x", "Foo")


@query(f"""with s as (select p_partkey, {sql_pick(SYMBOLS, 'p_partkey')} as s from part) select p_partkey, length(s) > 2 and (not regexp_matches(s, '^[A-Z][a-z]+([A-Z][a-z]+)*$') or regexp_matches(s, '^(?i)({P.VERBS})(?-i)[A-Z_]')) as function_like, list_contains(string_split(p_name, ' '), 'red') as has_symbol, len(string_split(p_name, ' ')) > 0 as has_any from part join s using (p_partkey)""")
def symbol_predicates(spark, t):
    """Containment, non-empty arrays, names that look like functions."""
    s = pick(SYMBOLS, F.col("p_partkey"))
    words = F.split("p_name", " ")
    return t("part").select("p_partkey", P.is_function_like(s).alias("function_like"), F.array_contains(words, "red").alias("has_symbol"), (F.size(words) > 0).alias("has_any"))


@query("""select count(*) as n from documents where contains(text, '<!-- sticky -->') or contains(text, 'token')""")
def marker_filter(spark, t):
    """P21."""
    return t("documents").where(F.col("text").contains("<!-- sticky -->") | F.col("text").contains("token")).agg(F.count("*").alias("n"))
