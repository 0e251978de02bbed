"""Retrieval for a change: relations between chunks, file-type strategies, stages, and the context that is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.predicates import is_sensitive
from textquarry.functions.text import base_name, escape_xml, parent_path, suffix
from textquarry.operators.automaton import occurring
from textquarry.operators.search import few
from textquarry.storage import cut

#: Results that each stage may give, and the weight of what a stage finds.
STAGE_LIMITS = {"keyword": 15, "vector": 20, "definition": 10, "usage": 15, "caller": 5, "callee": 5}
STAGE_WEIGHTS = {"definition": (0.8, 1.3), "usage": (0.7, 1.1), "caller": (0.75, 1.2), "callee": (0.7, 1.2)}
KEYWORD_SYMBOLS, KEYWORD_NAMES, VECTOR_QUERIES, VECTOR_INTENTS, VECTOR_WEIGHT = 5, 5, 8, 4, 1.0
#: Ids of a class that lie in one row, and pairs that a task puts out, about.
PART_IDS, PAIRS_AT_ONCE = 1000, 20_000_000
SECTIONS = ("modified", "test", "definition", "similar", "config", "import")

_TYPESCRIPT = (
    (r":\s*(\w+)(?:<[^>]+>)?(?:\s*[=;,)\]}|&]|$)", "interface $1", 1.5), (r"extends\s+(\w+)(?:<[^>]+>)?", "class $1", 1.6), (r"implements\s+([\w,\s]+)", "interface $1", 1.6), (r"<(\w+)(?:\s+extends\s+\w+)?>", "type $1", 1.3),
    (r"import\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", "$1 $2", 1.4), (r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", "$1", 1.4),
)
_SCRIPT_NAMES = (r"interface\s+(\w+)", r"type\s+(\w+)\s*[=<]", r"class\s+(\w+)", r"function\s+(\w+)", r"const\s+(\w+)\s*=\s*(?:async\s*)?\(", r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*(?::\s*\w+)?\s*\{")
_CSS = ((r"var\(--([a-zA-Z0-9-]+)\)", "--$1", 1.6), (r"\.([a-zA-Z][a-zA-Z0-9_-]+)", ".$1", 1.3))
_CSS_NAMES = (r"\.([a-zA-Z][a-zA-Z0-9_-]+)", r"#([a-zA-Z][a-zA-Z0-9_-]+)", r"--([a-zA-Z][a-zA-Z0-9_-]+)")
_CSS_FILES = ("{dir}_variables{ext}", "{dir}variables{ext}", "{in}_vars{ext}", "{dir}_mixins.scss", "{dir}mixins.scss", "{dir}_base{ext}", "{dir}base{ext}", "{in}_reset{ext}")
#: By file type its extensions, patterns whose matches are looked up (with what is asked and a weight), patterns of names,
#: related files ({in}: only in a folder; {up}: in the folder and all above it) and the weight of its chunks.
STRATEGIES = {
    "typescript": ((".ts", ".tsx"), _TYPESCRIPT, _SCRIPT_NAMES, ("{base}.d.ts", "{base}.types.ts", "{base}/types.ts", "types/{stem}.ts", "{dir}index.ts", "{dir}index.tsx"), 1.5),
    "javascript": ((".js", ".jsx", ".mjs", ".cjs"), (_TYPESCRIPT[1], _TYPESCRIPT[2], _TYPESCRIPT[4], _TYPESCRIPT[5]), _SCRIPT_NAMES[2:], ("{dir}index.js", "{dir}index.mjs"), 1.4),
    "python": (
        (".py",),
        ((r"class\s+\w+\s*\(([^)]+)\)", "class $1", 1.6), (r"@(\w+)(?:\([^)]*\))?", "def $1", 1.5), (r"->\s*(\w+)(?:\[[^\]]+\])?", "class $1", 1.4), (r":\s*(\w+)(?:\[[^\]]+\])?\s*[=,)]", "class $1", 1.4), (r"from\s+([\w.]+)\s+import\s+(.+)", "$2", 1.4)),
        (r"class\s+(\w+)", r"def\s+(\w+)", r"async\s+def\s+(\w+)", r"@(\w+)", r"from\s+[\w.]+\s+import\s+(\w+)"),
        ("{dir}__init__.py", "{in}base.py", "{in}abc.py", "{in}interfaces.py", "{up}conftest.py"),
        1.5,
    ),
    "go": (
        (".go",),
        ((r"type\s+(\w+)\s+interface", "interface $1", 1.6), (r"type\s+\w+\s+struct\s*\{[^}]*\n\s*(\w+)\s*\n", "type $1", 1.5), (r"func\s*\(\s*\w+\s+\*?(\w+)\s*\)", "type $1", 1.5), (r"import\s+(?:\w+\s+)?\"([^\"]+)\"", "$1", 1.3)),
        (r"func\s+(?:\([^)]+\)\s*)?(\w+)", r"type\s+(\w+)\s+(?:struct|interface)", r"const\s+(\w+)", r"var\s+(\w+)"),
        ("{dir}doc.go", "{dir}interfaces.go", "{dir}types.go", "{dir}contract.go"),
        1.5,
    ),
    "css": ((".css",), _CSS, _CSS_NAMES, _CSS_FILES, 1.5),
    "scss": (
        (".scss", ".sass"),
        (*_CSS, (r"\$([a-zA-Z][a-zA-Z0-9_-]+)", "$$$1", 1.6), (r"@include\s+([a-zA-Z][a-zA-Z0-9_-]+)", "@mixin $1", 1.7), (r"@extend\s+([.%][a-zA-Z][a-zA-Z0-9_-]+)", "$1", 1.6)),
        (*_CSS_NAMES, r"\$([a-zA-Z][a-zA-Z0-9_-]+)", r"@mixin\s+([a-zA-Z][a-zA-Z0-9_-]+)", r"@function\s+([a-zA-Z][a-zA-Z0-9_-]+)"),
        _CSS_FILES,
        1.5,
    ),
    "rust": ((), (), (), (), 1.0),
    "java": ((), (), (), (), 1.0),
    "generic": ((), (), (), (), 1.0),
}


def _sides(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """rows: (id, token). Classes (`side`, tokens, n, parts) of ids with the same tokens, and their ids (`side`, part, ids) in parts."""
    ids = cut(rows.groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("tokens")).withColumn(side, F.sha2(F.to_json("tokens"), 256)))
    classes = cut(ids.groupBy(side).agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART_IDS).cast("int")))
    dealt = ids.select(side, "id").join(classes.select(side, "parts"), side).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return classes, dealt.groupBy(side, "part").agg(F.collect_list("id").alias("ids"))


def relations(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """(src, dst, kind) of chunks (id, content, symbols, imports, exports).

    imports: an imported name is another chunk's symbol or export. references: a chunk's text has another's symbol
    followed by "(", by "." or between blanks, also inside of a longer word; only the first form respects that the pair is already
    an import, unless `strict` says that all do. One automaton of all forms of all symbols goes over each text once; texts are not shuffled.

    Chunks that want the same names are one class, and so are chunks that offer the same. Kinds are decided between classes, whose
    ids lie in parts of about PART_IDS. Only two parts at a time become pairs, last of all, so no pair is shuffled or stored.
    """
    token = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    offered = chunks.select("id", F.explode(F.array_distinct(F.concat("symbols", F.filter("exports", lambda e: ~e.startswith("* from "))))).alias("name")).where("name is not null")
    symbols = chunks.select("id", F.explode(F.array_distinct("symbols")).alias("symbol")).where("length(symbol) >= 3")
    targets, target_ids = _sides(offered.select("id", token("imports", "name").alias("token")).unionByName(symbols.select("id", token("references", "symbol").alias("token"))), "target")
    names = cut(targets.select(F.explode("tokens").alias("token")).select("token.*").distinct())
    forms = F.array(*[F.struct(F.concat(F.lit(pre), "symbol", F.lit(post)).alias("string"), F.lit(post == "(").alias("call")) for pre, post in (("", "("), ("", "."), (" ", " "))])
    looked = cut(names.where("kind = 'references'").select(F.col("name").alias("symbol")).select("symbol", F.inline(forms)))
    use = lambda kind, name, call: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), call.alias("call")).alias("token")
    wanted = chunks.select("id", F.explode(F.array_distinct("imports")).alias("name")).join(few(names.where("kind = 'imports'").select("name")), "name", "left_semi")
    found = occurring(chunks, "id", "content", looked).join(few(looked), "string")
    sources, source_ids = _sides(wanted.select("id", use("imports", "name", F.lit(False))).unionByName(found.select("id", use("references", "symbol", F.col("call")))), "source")
    met = sources.select("source", F.explode("tokens").alias("token")).select("source", "token.*").join(targets.select("target", F.explode("tokens").alias("token")).select("target", "token.*"), ["kind", "name"])
    imported, referred = (F.max(F.col("kind") == k) for k in ("imports", "references"))
    seen = met.groupBy("source", "target").agg(imported.alias("imported"), referred.alias("referred"), F.min(F.when(F.col("kind") == "references", F.col("call"))).alias("guarded"))
    refers = F.col("referred") & (~F.col("imported") | F.lit(not strict) & ~F.col("guarded"))
    kinds = F.array_compact(F.array(F.when(F.col("imported"), F.lit("imports")), F.when(refers, F.lit("references"))))
    related = cut(seen.select("source", "target", kinds.alias("kinds")).where("size(kinds) > 0"))
    parts = lambda classes, side, k: classes.select(side, F.col("n").alias(f"n{k}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part{k}"), F.col("parts").alias(f"of{k}"))
    blocks = cut(related.join(parts(sources, "source", 1), "source").join(parts(targets, "target", 2), "target"))
    pairs = blocks.agg(F.sum(F.col("n1") / F.col("of1") * F.col("n2") / F.col("of2") * F.size("kinds"))).first()[0] or 0
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / PAIRS_AT_ONCE) + 1)
    left = blocks.select("source", "part1", "target", "part2", "kinds").join(source_ids.select("source", F.col("part").alias("part1"), F.col("ids").alias("srcs")), ["source", "part1"])
    both = left.repartition(tasks, "target", "part2").join(target_ids.select("target", F.col("part").alias("part2"), F.col("ids").alias("dsts")).repartition(tasks, "target", "part2"), ["target", "part2"])
    # Compiled together, both steps would hold all pairs of two parts as rows before the first goes on; a coalesce that changes no
    # partition parts them, so only the pairs of one chunk are held.
    each = both.select(F.explode("kinds").alias("kind"), "srcs", "dsts").select("kind", F.explode("srcs").alias("src"), "dsts").coalesce(tasks)
    return each.select("src", F.explode("dsts").alias("dst"), "kind").where("src <> dst")


def file_type(path: Column, mapped: dict[str, str] | None = None, disabled: tuple[str, ...] = ()) -> Column:
    """The type of a file by its extension. `mapped` adds extensions to types; `disabled` types are generic."""
    own = {e: name for name, (extensions, *_) in STRATEGIES.items() for e in extensions} | (mapped or {})
    end = F.lower(suffix(path))
    out = F.lit("generic")
    for extension, name in own.items():
        out = F.when(end == extension, "generic" if name in disabled and name != "generic" else name).otherwise(out)
    return out


def _by_type(kind: Column, value, empty: Column) -> Column:
    out = empty
    for name in STRATEGIES:
        if (v := value(*STRATEGIES[name])) is not None:
            out = F.when(kind == name, v).otherwise(out)
    return out


def priority_queries(kind: Column, code: Column) -> Column:
    """Array of (query, weight): what a file's type asks for in its code, pattern by pattern; under three characters dropped."""
    none = F.array().cast("array<struct<query:string,weight:double>>")

    def asked(pattern: str, template: str, weight: float) -> Column:
        group = lambda i: F.regexp_extract_all(code, F.lit(pattern), F.lit(i))
        head = template.split("$1")[0] if "$1" in template else ""
        if "$2" not in template:
            return F.transform(group(1), lambda x: F.struct(F.concat(F.lit(head), F.trim(x)).alias("query"), F.lit(weight).alias("weight")))
        text = (lambda x, y: F.concat(F.trim(x), F.lit(" "), F.trim(y))) if "$1" in template else (lambda x, y: F.trim(y))
        return F.zip_with(group(1), group(2), lambda x, y: F.struct(text(x, y).alias("query"), F.lit(weight).alias("weight")))

    hits = _by_type(kind, lambda e, patterns, *_: F.flatten(F.array(*[asked(*p) for p in patterns])) if patterns else None, none)
    return F.filter(F.transform(hits, lambda h: F.struct(F.trim(h["query"]).alias("query"), h["weight"].alias("weight"))), lambda h: F.length(h["query"]) >= 3)


def strategy_names(kind: Column, code: Column) -> Column:
    """Distinct names of three characters or more that a file's type looks for in its code."""
    none = F.array().cast("array<string>")
    hits = _by_type(kind, lambda e, p, names, *_: F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(n), F.lit(1)) for n in names])) if names else None, none)
    return F.array_distinct(F.filter(hits, lambda h: F.length(h) >= 3))


def strategy_queries(kind: Column, code: Column, most: int = 10) -> Column:
    """Distinct queries of a file by its type: the weighted ones, then the names, `most` at the highest."""
    return F.slice(F.array_distinct(F.concat(F.transform(priority_queries(kind, code), lambda h: h["query"]), strategy_names(kind, code))), 1, most)


def related_paths(path: Column, kind: Column | None = None) -> Column:
    """Distinct files that belong to a file by its type."""
    folder, name = parent_path(path), base_name(path)
    inside = F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(F.lit(""))
    base = F.regexp_replace(path, r"\.(ts|tsx|js|jsx)$", "")
    steps = F.split(path, "/")
    above = F.transform(F.reverse(F.sequence(F.lit(0), F.size(steps) - 1)), lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))).otherwise(F.lit("")))
    parts = {"{dir}": inside, "{base}": base, "{stem}": F.regexp_replace(name, r"\.(ts|tsx|js|jsx)$", ""), "{ext}": F.when(path.endswith(".scss"), ".scss").otherwise(".css"), "{in}": inside}

    def filled(template: str) -> Column:
        if template.startswith("{up}"):
            return F.transform(above, lambda a: F.concat(a, F.lit(template.removeprefix("{up}"))))
        out = F.lit(template)
        for mark, value in parts.items():
            if mark in template:
                out = F.replace(out, F.lit(mark), value)
        none = F.array().cast("array<string>")
        return F.when(folder == "", none).otherwise(F.array(out)) if "{in}" in template else F.array(out)

    own = file_type(path) if kind is None else kind
    return F.array_distinct(_by_type(own, lambda e, p, n, files, *_: F.flatten(F.array(*map(filled, files))) if files else None, F.array().cast("array<string>")))


def strategy_weight(kind: Column, overrides: dict[str, float] | None = None) -> Column:
    """Weight of chunks by file type, unless overridden."""
    return _by_type(kind, lambda *spec: F.lit(spec[-1]), F.lit(1.0)) if not overrides else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in overrides.items() for x in (k, float(v))]), kind), strategy_weight(kind))


def stage_queries(requests: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, stage, position, query) of requests (by, symbols, diff_queries, description_queries): what the keyword stage asks
    (five symbols, then the first five queries that are identifiers) and the vector stage (eight of a diff, four of a description)."""
    names = F.filter("diff_queries", lambda q: q.rlike(r"^\w+$"))
    keyword = F.concat(F.slice("symbols", 1, KEYWORD_SYMBOLS), F.slice(names, 1, KEYWORD_NAMES))
    vector = F.concat(F.slice("diff_queries", 1, VECTOR_QUERIES), F.slice("description_queries", 1, VECTOR_INTENTS))
    each = lambda stage, qs: requests.select(by, F.lit(stage).alias("stage"), F.posexplode(qs).alias("position", "query"))
    return each("keyword", keyword).unionByName(each("vector", vector))


def keyword_stage(found: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, id, source, score, is_exact) of ranked keyword hits (by, position, id, score, boost, rank) of a request's queries:
    fifteen of each, a chunk from the first query that finds it."""
    hits = found.where(F.col("rank") <= STAGE_LIMITS["keyword"])
    first = hits.groupBy(by, "id").agg(F.min_by(F.struct("score", "boost"), "position").alias("x"))
    exact = F.col("x.boost") > 1
    return first.select(by, "id", F.lit("keyword").alias("source"), keyword_stage_weight(F.col("x.score"), exact).alias("score"), exact.alias("is_exact"))


def vector_stage(found: DataFrame, held: DataFrame | None = None, by: str = "query_id") -> DataFrame:
    """The same of hybrid hits (by, position, id, vector_score, rank): twenty of each query, without chunks that `held` has.

    A chunk that only keywords found has no vector score and counts zero.
    """
    hits = found.where(F.col("rank") <= STAGE_LIMITS["vector"])
    if held is not None:
        hits = hits.join(held.select(by, "id").distinct(), [by, "id"], "left_anti")
    first = hits.groupBy(by, "id").agg(F.min_by(F.coalesce("vector_score", F.lit(0.0)), "position").alias("s"))
    return first.select(by, "id", F.lit("vector").alias("source"), (F.col("s") * VECTOR_WEIGHT).alias("score"), F.lit(False).alias("is_exact"))


def flat_retrieval(hits: DataFrame, chunks: DataFrame, modified: DataFrame, tests: DataFrame | None = None, strategy: Column | None = None, most: int = 20, budget: int = 16_000, by: str = "query_id") -> DataFrame:
    """(by, id, score, used, is_modified, in_description, is_test): what a request shows of the hits of all its queries.

    hits: (by, query, id, score, of_description), the best score of a chunk counts; chunks: (id, file, code); modified: (by,
    id) of chunks that a change overlaps, weighed twice; chunks of a description's query 1.3 times; `strategy` is a weight
    by chunk; tests: (by, id, score), weighed already. By score, as long as the tokens fit and at most twice `most`.
    """
    from textquarry.operators.windows import estimated_tokens, token_budget

    found = hits.groupBy(by, "id").agg(F.max("score").alias("s"), F.bool_or("of_description").alias("in_description"))
    marked = found.join(modified.select(by, "id").distinct().withColumn("m", F.lit(True)), [by, "id"], "left").withColumn("is_modified", F.coalesce("m", F.lit(False)))
    both = marked.join(chunks, "id")
    weighed = F.col("s") * F.when(F.col("is_modified"), 2.0).otherwise(1.0) * F.when(F.col("in_description"), 1.3).otherwise(1.0) * (F.lit(1.0) if strategy is None else strategy)
    rows = both.select(by, "id", weighed.alias("score"), "code", "is_modified", "in_description", F.lit(False).alias("is_test"))
    if tests is not None:
        more = tests.join(chunks, "id").select(by, "id", "score", "code", F.lit(False).alias("is_modified"), F.lit(False).alias("in_description"), F.lit(True).alias("is_test"))
        rows = rows.unionByName(more)
    best = Window.partitionBy(by, "id").orderBy(F.desc("score"), "is_test")
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    ranked = rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * most)
    return token_budget(ranked.withColumn("cost", estimated_tokens(F.col("code"))), F.col("cost"), [F.desc("score"), F.col("id")], budget, by=[by]).drop("code", "_r", "_n", "cost")


def structural_stage(
    symbols: DataFrame, definitions: DataFrame, usages: DataFrame, callers: DataFrame | None = None, callees: DataFrame | None = None, most_symbols: int = 8, by: str | None = None
) -> DataFrame:
    """(id, source, score, is_exact, symbol) for asked symbols (symbol, position): definitions, usages and, of symbols that look
    like functions, callers and callees (each symbol, id, file, line), capped per symbol and stage; the first stage that finds
    a chunk keeps it. With `by`, for each request of symbols (by, symbol, position)."""
    from textquarry.functions.predicates import is_function_like

    of = [by] if by else []
    if by:
        asked = symbols.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("position", "symbol"))).where(F.col("_n") <= most_symbols).drop("_n")
    else:
        asked = symbols.orderBy("position").limit(most_symbols)
    parts = []
    for order, (name, rows) in enumerate((("definition", definitions), ("usage", usages), ("caller", callers), ("callee", callees))):
        if rows is None:
            continue
        base, boost = STAGE_WEIGHTS[name]
        w = Window.partitionBy(*of, "symbol").orderBy("file", "line", "id")
        meant = asked if name in ("definition", "usage") else asked.where(is_function_like(F.col("symbol")))
        hit = rows.join(meant, "symbol").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= STAGE_LIMITS[name])
        parts.append(hit.select(*of, "id", F.lit(name).alias("source"), F.lit(base * boost).alias("score"), F.lit(name == "definition").alias("is_exact"), "symbol", "position", F.lit(order).alias("_o")))
    both = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy(*of, "id").orderBy("position", "_o")
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*of, "id", "source", "score", "is_exact", "symbol")


def paths_alike(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(file, changed): distinct paths of which one ends with the other. Each path meets the others by its own endings, of which it has as
    many as characters; so nothing is shared by all files of a language."""
    a, b = files.select("file").distinct(), changed.select("changed").distinct()
    endings = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), i, F.length(c)))).alias("ending")
    longer = a.where("file <> ''").select("file", endings("file")).join(b, F.col("ending") == F.col("changed")).select("file", "changed")
    shorter = b.where("changed <> ''").select("changed", endings("changed")).join(a, F.col("ending") == F.col("file")).select("file", "changed")
    return longer.unionByName(shorter).distinct()


def overlapping_chunks(chunks: DataFrame, lines: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, id) of chunks (id, file, start, end) that hold a changed line (by, file, line) of a file whose path is theirs or
    ends as theirs does."""
    from textquarry.functions.predicates import overlaps

    a, b = chunks.select("id", "file", "start", "end"), lines.select(by, F.col("file").alias("changed"), "line").distinct()
    met = a.join(paths_alike(a, b), "file").join(b, "changed")
    return met.where(overlaps(F.col("start"), F.col("end"), F.col("line"))).select(by, "id").distinct()


def keyword_stage_weight(score: Column, is_exact: Column) -> Column:
    """Score over ten, at most 1; half more for exact symbols, a fifth more above 0.5."""
    base = F.least(F.lit(1.0), score / 10)
    return base * F.when(is_exact, 1.5).when(base > 0.5, 1.2).otherwise(1.0)


def ends_early(results: DataFrame, by: str, threshold: float = 0.9) -> DataFrame:
    """(by, stop): five results, and the best three above the threshold or five exact ones."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    ranked = results.withColumn("_r", F.row_number().over(w))
    figures = ranked.groupBy(by).agg(F.count("*").alias("n"), F.count_if((F.col("_r") <= 3) & (F.col("score") > threshold)).alias("sure"), F.count_if("is_exact").alias("exact"))
    return figures.select(by, ((F.col("n") >= 5) & ((F.col("sure") >= 3) | (F.col("exact") >= 5))).alias("stop"))


def staged(stages: list[DataFrame], by: str = "query_id", threshold: float = 0.9, most: int = 20) -> DataFrame:
    """Stages (query_id, id, source, score, is_exact) one after the other, and the `most` best rows of each query with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return held_rows(stages, by, threshold).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= most)


def held_rows(stages: list[DataFrame], by: str = "query_id", threshold: float = 0.9) -> DataFrame:
    """What the stages find: a query that is sure goes to no further stage, and a chunk keeps its first stage's row.

    Everything is one plan: a later stage is anti-joined with the finished queries.
    """
    held = None
    for i, stage in enumerate(stages):
        rows = stage.select(by, "id", "source", "score", "is_exact").withColumn("stage", F.lit(i))
        if held is not None:
            done = ends_early(held, by, threshold).where("stop").select(by)
            rows = rows.join(done, by, "left_anti").join(held.select(by, "id"), [by, "id"], "left_anti")
            rows = held.unionByName(rows)
        held = rows
    return held


#: Fixed value: the weight of a chunk that holds a changed line.
LINE_WEIGHT = 1.5


def staged_retrieval(
    keyword: DataFrame, vector: DataFrame, structural: DataFrame, chunks: DataFrame, modified: DataFrame, most: int = 20, budget: int = 16_000, by: str = "query_id", threshold: float = 0.9
) -> DataFrame:
    """(by, id, source, score, stage, rank): the keyword, vector and structural stage of each request one after the other, reranked and packed.

    keyword and vector: ranked hits of a request's queries as `keyword_stage` and `vector_stage` take them; structural: rows of
    `structural_stage` by request; chunks: (id, code); modified: (by, id) of chunks that hold a
    changed line, or (id) where all requests are of one change. After the stages
    such chunks weigh more, the best `most` stay, and of these as many as the tokens allow.
    """
    from textquarry.operators.windows import estimated_tokens, token_budget

    first = cut(keyword_stage(keyword, by))
    second = vector_stage(vector, first, by)
    held = cut(held_rows([first, second, structural], by, threshold))  # read by the sums of each stage
    on = [c for c in (by, "id") if c in modified.columns]
    marked = held.join(modified.select(*on).distinct().withColumn("_m", F.lit(LINE_WEIGHT)), on, "left")
    weighed = marked.withColumn("score", F.col("score") * F.coalesce("_m", F.lit(1.0))).drop("_m")
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    ranked = few(cut(weighed.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= most)))  # texts come to the rows, unless these are many
    packed = token_budget(ranked.join(chunks.select("id", "code"), "id").withColumn("cost", estimated_tokens(F.col("code"))), F.col("cost"), [F.col("rank")], budget, by=[by])
    return packed.select(by, "id", "source", "score", "stage", "rank")


def relevance(score: Column, is_modified: Column, is_test: Column, in_description: Column) -> Column:
    return F.when(is_modified | is_test | (in_description & (score > 0.7)), "high").when((score > 0.5) | in_description, "medium").otherwise("low")


def reason(is_modified: Column, is_test: Column, source_file: Column, in_description: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(is_modified, F.lit("overlaps with modified lines")),
            F.when(is_test, F.coalesce(F.concat(F.lit("test file for "), source_file), F.lit("related test file"))),
            F.when(in_description, F.lit("matches PR/MR description intent")),
        )
    )
    return F.when(F.size(parts) == 0, "semantically similar to changes").otherwise(F.array_join(parts, "; "))


def xml_context(chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, xml) of the chunks that a request keeps (file, start, end, code, score, is_modified, is_test, source_file,
    in_description): sections in their order, chunks by score."""
    section = F.when(F.col("is_modified"), "modified").when(F.col("is_test"), "test").otherwise("similar")
    level = relevance(F.col("score"), F.col("is_modified"), F.col("is_test"), F.col("in_description"))
    why = reason(F.col("is_modified"), F.col("is_test"), F.col("source_file"), F.col("in_description"))
    attribute = lambda k, v: F.concat(F.lit(f' {k}="'), escape_xml(v), F.lit('"'))
    lines = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    element = F.concat(F.lit("<context"), attribute("type", section), attribute("path", F.col("file")), attribute("relevance", level), attribute("lines", lines), attribute("reason", why), attribute("score", F.format_string("%.3f", "score")), F.lit(">\n"), escape_xml(F.col("code")), F.lit("\n</context>"))
    rows = chunks.select(by, section.alias("section"), F.struct((-F.col("score")).alias("o"), F.col("file"), F.col("start"), element.alias("x")).alias("row"))
    body = rows.groupBy(by, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["x"]), "\n").alias("body"))
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    whole = F.concat(F.lit("<"), "section", F.lit(">\n"), "body", F.lit("\n</"), "section", F.lit(">"))
    return body.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), whole.alias("x")))), lambda r: r["x"]), "\n\n").alias("xml"))


def tool_results(hits: DataFrame, path: str, limit: int | None, default: int = 10, most: int = 50) -> DataFrame:
    """Ranked hits with the limit clamped; files that may hold secrets are left out after that."""
    return hits.where(F.col("rank") <= min(limit or default, most)).where(~is_sensitive(F.col(path)))


def config_chunks(files: DataFrame, path: str, content: str) -> DataFrame:
    """One chunk per configuration file; its symbols are what it declares."""
    from textquarry.functions.predicates import config_type
    from textquarry.operators.chunking import config_metadata

    kind = config_type(F.col(path))
    m = config_metadata(F.col(content), kind)
    rows = files.where(kind.isNotNull()).select(F.col(path), F.col(content).alias("code"), m.alias("m"), F.size(F.split(content, "\n")).alias("end_line"))
    return rows.select(path, "code", F.lit(1).alias("start_line"), "end_line", F.lit("config").alias("chunk_type"), F.array_compact(F.concat(F.array("m.config_type", "m.target_version"), "m.dependencies", "m.dev_dependencies")).alias("symbol_names"))
