"""Registered queries of the operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import load

#: Filled by @query in the order of the operators.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.token_files import token_file_digests

    return token_file_digests(load(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", end_id=1)


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.simhash import simhash_components

    out = simhash_components(load(spark, sf_dir, "documents"), words=4, seed=42, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.line_dedup import dedup_lines

    return dedup_lines(load(spark, sf_dir, "documents"), edits=2, least_chars=12)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.decontaminate import contamination

    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(load(spark, sf_dir, "documents"), width=100)


@query
def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.sharding import kd_shards

    return kd_shards(load(spark, sf_dir, "documents"), shards=24)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.url_filter import judge_urls

    return judge_urls(load(spark, sf_dir, "pages"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.quality import quality_scores

    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), threshold=0.3)


@query
def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.merkle import document_fingerprints

    return document_fingerprints(load(spark, sf_dir, "documents"))


#: The mixing tree's weights; domains are groups of sources.
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "*": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "*": 1}, "source": {"*": 1}}
MIX_DOMAINS = "case when source in ('src0','src1','src2','src3','src4','src5','src6') then 'web' when source in ('src7','src8','src9','src10','src11','src12','src13') then 'books' when source is null then null else 'forums' end"


def mix_levels() -> dict:
    return {"domain": F.expr(MIX_DOMAINS), "lang": F.col("lang"), "source": F.col("source")}


def _mix_sql(share: tuple[int, int], epochs: int, seed: int) -> str:
    """The mixing tree in SQL: water-filling level by level, then each leaf's prefix of its epoch's order."""
    levels = list(MIX_WEIGHTS)
    weight = lambda c: "case " + c + " " + " ".join(f"when '{k}' then {w}" for k, w in MIX_WEIGHTS[c].items() if k != "*") + f" else {MIX_WEIGHTS[c]['*']} end" if len(MIX_WEIGHTS[c]) > 1 else str(MIX_WEIGHTS[c]["*"])
    ctes = [
        f"""r as (select doc_id, coalesce({MIX_DOMAINS}, 'unknown') as domain, coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as tokens from documents)""",
        f"leaf as (select domain, lang, source, sum(tokens) as t, {epochs} * sum(tokens) as holds from r group by all)",
        f"g0 as (select coalesce(sum(t), 0) * {share[0]} // {share[1]} as budget from leaf)",
    ]
    for i, level in enumerate(levels):
        path, parent = levels[: i + 1], levels[:i]
        over = (f"partition by {', '.join(parent)} " if parent else "") + f"order by holds / weight, {level} rows between unbounded preceding and 1 preceding"
        whole = f"partition by {', '.join(parent)}" if parent else ""
        join = f"join g{i} using ({', '.join(parent)})" if parent else "cross join g0"  # g0 is one row
        ctes += [
            f"n{i} as (select * from (select {', '.join(path)}, sum(holds) as holds, {weight(level)} as weight from leaf group by {', '.join(path)}) {join} where holds > 0 and weight > 0)",
            f"o{i} as (select *, coalesce(sum(holds) over ({over}), 0) as held_before, sum(weight) over ({whole}) - coalesce(sum(weight) over ({over}), 0) as weight_left from n{i})",
            f"s{i} as (select *, holds * weight_left <= weight * (budget - held_before) as short from o{i})",
            f"u{i} as (select *, coalesce(sum(holds) filter (short) over ({whole}), 0) as used, coalesce(sum(weight) filter (not short) over ({whole}), 0) as open_weight from s{i})",
            f"g{i + 1} as (select {', '.join(path)}, case when short then holds else least(weight * (budget - used) // open_weight, holds) end as budget from u{i})",
        ]
    names = ", ".join(levels)
    ctes += [
        f"plan as (select {names}, case when t > 0 then coalesce(budget, 0) // t else 0 end as epochs_full, case when t > 0 then coalesce(budget, 0) % t else 0 end as rest from leaf left join g{len(levels)} using ({names}))",
        f"h as (select *, md5('{seed}:' || epochs_full || ':' || doc_id) as h from r join plan using ({names}))",
        f"x as (select *, sum(tokens) over (partition by {names} order by h, doc_id range between unbounded preceding and current row) as upto from h)",
    ]
    return "with " + ", ".join(ctes) + f" select doc_id, {names}, tokens, cast(epochs_full + case when rest > 0 and upto <= rest then 1 else 0 end as integer) as copies from x"


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.mixing import mix

    return mix(load(spark, sf_dir, "documents"), levels=mix_levels(), weights=MIX_WEIGHTS, budget_share=(1, 2), max_epochs=2, seed=13)


ORACLES["op10_mixing"] = _mix_sql((1, 2), 2, 13)


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.bpe_transducer import round_trip_digests

    return round_trip_digests(load(spark, sf_dir, "documents"), ranks="byte_bpe_multi_50k.tiktoken")


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.alignment import align

    return align(load(spark, sf_dir, "documents"), a="byte_bpe_50k.json", b="piece_bpe_32k.model")


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.llm.divergence import audit

    return audit(load(spark, sf_dir, "documents"), least_docs=3, most_ranks=200)


ORACLES["op12_divergence"] = r"""
with d as (select row_number() over () as r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
g as (select distinct lang, source from d),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as c from w group by lang, term having count(distinct r) >= 3),
vs as (select lang, count(*) as v, sum(c) as n from kept group by lang),
c as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
n as (select lang, source, sum(c) as n from c group by all),
p as (select g.lang, g.source, kept.term, coalesce(c.c, 0) as c, cast(1 + (1000000000 * (coalesce(c.c, 0)::hugeint + 1)) // (coalesce(n.n, 0) + v) as bigint) as p, cast(1 + (1000000000 * (kept.c::hugeint + 1)) // (vs.n + v) as bigint) as q
  from g join kept on g.lang = kept.lang join vs on vs.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term left join n on n.lang = g.lang and n.source = g.source),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p as a join p as b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from g as a join g as b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // q as bigint) as value from p where c > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 200
"""
