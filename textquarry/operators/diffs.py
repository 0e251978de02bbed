"""Unified diffs: changed lines, changed files and the queries that they suggest."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.predicates import is_test_file

LINE = "array<struct<file:string,line:int,side:string,change:string,content:string>>"


def parse_diff(diff: str | None) -> list[dict]:
    """Changed lines with their numbers; a run of deletions that additions follow makes pairs of modifications.

    Additions and modifications have line numbers of the new file, deletions of the old one (`side` says which).
    """
    out: list[dict] = []
    file = None
    old = new = 0
    gone: list[tuple[int, str]] = []
    inside = False

    def flush() -> None:
        out.extend({"file": file, "line": n, "side": "old", "change": "deletion", "content": c} for n, c in gone)
        gone.clear()

    for line in (diff or "").split("\n"):
        if line.startswith("diff --git"):
            flush()
            inside, file = False, None
        elif not inside and line.startswith("+++ "):
            target = line[4:].split("\t")[0].strip()
            file = None if target == "/dev/null" else re.sub(r"^b/", "", target)
        elif not inside and line.startswith("--- "):
            source = line[4:].split("\t")[0].strip()
            file = None if source == "/dev/null" else re.sub(r"^a/", "", source)
        elif m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line):
            flush()
            old, new, inside = int(m[1]), int(m[2]), True
        elif inside and file:
            if line.startswith("-"):
                gone.append((old, line[1:]))
                old += 1
            elif line.startswith("+"):
                if gone:
                    gone.pop(0)
                    out.append({"file": file, "line": new, "side": "new", "change": "modification", "content": line[1:]})
                else:
                    out.append({"file": file, "line": new, "side": "new", "change": "addition", "content": line[1:]})
                new += 1
            elif line.startswith("\\"):
                continue
            else:
                flush()
                old, new = old + 1, new + 1
    flush()
    return out


def diff_lines(diff: Column) -> Column:
    def run(diffs: pd.Series) -> pd.Series:
        return pd.Series([parse_diff(d) for d in diffs])

    return F.pandas_udf(run, LINE)(diff)


def changed_lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, file, line, side, change, content): a state machine per diff, in Arrow batches."""
    return diffs.select(key, F.inline(diff_lines(F.col(diff))))


def lines_by_change(lines: DataFrame, key: str) -> DataFrame:
    """(key, file, additions, deletions, modifications): sorted line numbers."""
    return lines.groupBy(key, "file").agg(*[F.array_sort(F.collect_list(F.when(F.col("change") == c, F.col("line")))).alias(f"{c}s") for c in ("addition", "deletion", "modification")])


def new_code(lines: DataFrame, key: str) -> DataFrame:
    """(key, file, code): added and modified lines in order."""
    kept = lines.where("side = 'new'")
    return kept.groupBy(key, "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("code"))


def changed_files(diff: Column) -> Column:
    """Sorted distinct paths of the headers, without the null device."""
    plus = F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(\S+)"), F.lit(1))
    git = F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1))
    return F.array_sort(F.array_union(plus, git))


def source_files(files: Column) -> Column:
    return F.filter(files, lambda f: ~is_test_file(f))


#: What names a function or type in a line of code.
FUNCTION_PATTERNS = (
    r"function\s+(\w+)\s*[<(]", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function", r"class\s+(\w+)", r"interface\s+(\w+)", r"type\s+(\w+)\s*[=<]",
    r"(\w+)\s*:\s*(?:async\s+)?function", r"(\w+)\s*\([^)]*\)\s*\{", r"def\s+(\w+)\s*\(", r"class\s+(\w+)\s*[:(]", r"async\s+def\s+(\w+)\s*\(", r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", r"func\s+\([^)]+\)\s*(\w+)\s*\(",
    r"type\s+(\w+)\s+(?:struct|interface)", r"fn\s+(\w+)\s*[<(]", r"struct\s+(\w+)", r"enum\s+(\w+)", r"trait\s+(\w+)", r"impl\s+(?:<[^>]+>\s*)?(\w+)",
    r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:suspend\s+)?(?:\w+\s+)?(\w+)\s*\([^)]*\)", r"(?:data\s+)?class\s+(\w+)", r"object\s+(\w+)",
)
#: Import statements, with the names or the module in their groups.
IMPORT_PATTERNS = (
    r"import\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", r"import\s+(?:(\w+)|(\*\s+as\s+\w+))\s+from\s+['\"]([^'\"]+)['\"]", r"import\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"from\s+([\w.]+)\s+import\s+(.+)",
    r"import\s+([\w.]+)(?:\s+as\s+\w+)?", r"import\s+\"([^\"]+)\"", r"import\s+\w+\s+\"([^\"]+)\"", r"use\s+([\w:]+)(?:::\{([^}]+)\})?", r"import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;",
)
#: Types that a line names; all matches of each count.
TYPE_PATTERNS = (
    r":\s*(\w+)(?:<[^>]+>)?(?:\s*[=;,)\]}|&])", r":\s*(\w+)(?:<[^>]+>)?\s*\{", r":\s*(\w+)\s*$", r":\s*Promise<(\w+)>", r":\s*Array<(\w+)>", r":\s*Map<\w+,\s*(\w+)>", r":\s*Set<(\w+)>",
    r"(?:private|public|protected|readonly)\s+(?:readonly\s+)?(?:\w+\s+)?(\w+):\s*(\w+)", r"(?:private|public|protected|readonly)\s+(?:readonly\s+)?(\w+):\s*(\w+)", r"as\s+(\w+)(?:<[^>]+>)?", r"<(\w+)(?:,\s*\w+)*>", r"\((\w+)\)\s*\w+",
    r"implements\s+([\w,\s]+)", r"extends\s+(\w+)", r"->\s*(\w+)(?:[:\s\[]|$)", r":\s*(\w+)(?:\[[\w,\s]+\])?\s*=", r"\.\((\w+)\)",
)
#: String literals that name an event, a key or a route.
STRING_PATTERNS = (
    r"['\"]([a-z][a-zA-Z]*:[a-z][a-zA-Z]+)['\"]", r"['\"]on[A-Z]\w+['\"]", r"on\(['\"](\w+)['\"]", r"emit\(['\"](\w+)['\"]", r"addEventListener\(['\"](\w+)['\"]", r"['\"]([A-Z][A-Z_]+[A-Z])['\"]",
    r"action:\s*['\"](\w+)['\"]", r"type:\s*['\"](\w+)['\"]", r"['\"]\/api\/(\w+)", r"['\"]\/(\w+\/\w+)['\"]", r"query\s+(\w+)", r"mutation\s+(\w+)", r"(?:table|collection):\s*['\"](\w+)['\"]",
)
#: Words that are no names.
NOISE_WORDS = frozenset(
    """if for while switch catch return new throw try else break continue case default do finally with this super null undefined true false void typeof instanceof delete in of async await yield get set
    static public private protected readonly abstract final extends implements import export from as const let var function class interface type enum namespace module declare require package struct impl trait fn
    def lambda self cls pass raise except assert print main init test setup teardown describe it expect mock""".split()
)
#: Symbols that structural lookups ask for, and words that are none.
SYMBOL_PATTERNS = (
    r"function\s+(\w+)", r"def\s+(\w+)", r"func\s+(\w+)", r"fn\s+(\w+)", r"class\s+(\w+)", r"interface\s+(\w+)", r"type\s+(\w+)\s*[=<]", r"struct\s+(\w+)", r"(?:const|let|var)\s+(\w+)\s*=", r"\.(\w{3,})\s*\(",
    r"import\s+\{\s*([^}]+)\s*\}", r"from\s+['\"]([^'\"]+)['\"]",
)
KEYWORDS = frozenset(
    """if else for while do switch case break continue return try catch finally throw new delete typeof instanceof void null undefined true false this super class extends implements interface type enum const
    let var function async await import export from default static public private protected readonly abstract override get set constructor with in of""".split()
)
DIFF_QUERIES, QUERY_SOURCES = 15, {n: [re.compile(p, re.A) for p in ps] for n, ps in (("function", FUNCTION_PATTERNS), ("type", TYPE_PATTERNS), ("import", IMPORT_PATTERNS), ("string", STRING_PATTERNS))}
_SYMBOLS = [re.compile(p, re.A) for p in SYMBOL_PATTERNS]
_HEADERS = ("diff --git", "+++", "---", "index ", "@@", "new file", "deleted file", "Binary")


def _names(name: str) -> bool:
    return len(name) >= 3 and name.lower() not in NOISE_WORDS and not name.isdigit()


def _module_words(path: str) -> str:
    """A module's path as words: no scope mark, relative head or extension."""
    path = re.sub(r"^\.+/", "", path.removeprefix("@")).replace("/", " ")
    return re.sub(r"\.(js|ts|tsx|jsx|py|go|rs|java|kt)$", "", path).strip()


def line_queries(line: str) -> list[str]:
    """Names that a line of code holds, in the order of the pattern groups: functions, types, imports, strings."""
    out: list[str] = []
    for p in QUERY_SOURCES["function"]:
        if m := p.search(line):
            out += [g for g in m.groups() if g and _names(g)]
    for p in QUERY_SOURCES["type"]:
        for m in p.finditer(line):
            out += [x for x in (y.strip() for y in (m[1] or "").split(",")) if _names(x)]
    for p in QUERY_SOURCES["import"]:
        for group in (p.search(line) or re.match("", "")).groups():
            if not group:
                continue
            if "," in group or re.fullmatch(r"\w+", group.strip(), re.A):
                parts = (re.search(r"\w+\s+as\s+(\w+)", x, re.A) or re.match(r"\s*(\w+)", x, re.A) for x in group.split(","))
                out += [m[1] for m in parts if m and _names(m[1])]
            if len(words := _module_words(group)) > 2:
                out.append(words)
    for p in QUERY_SOURCES["string"]:
        if (m := p.search(line)) and m.groups() and m[1] and _names(m[1]):
            out.append(m[1])
    return out


def _hunks(diff: str) -> list[tuple[str, list[str]]]:
    """(file, changed lines) of each hunk that changes any."""
    out: list[tuple[str, list[str]]] = []
    file, open_hunk = "", False
    for line in diff.split("\n"):
        if m := re.match(r"diff --git a/.+ b/(.+)$", line):
            file, open_hunk = m[1], False
        elif re.match(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@", line):
            out.append((file, []))
            open_hunk = True
        elif open_hunk and line[:1] in ("+", "-") and not line.startswith(("+++", "---")):
            out[-1][1].append(line[1:])
    return [h for h in out if h[1]]


def queries_of_diff(diff: str | None, most: int = DIFF_QUERIES) -> list[str]:
    """What a diff asks for: the names of its changed lines, a query per hunk of its file's name and first names, and the
    first added lines as they are. Identifiers before others, shorter before longer, `most` at the highest."""
    found: dict[str, None] = {}
    changed = [x for x in (diff or "").split("\n") if x[:1] in ("+", "-") and not x.startswith(_HEADERS)]
    for line in changed:
        found.update(dict.fromkeys(line_queries(line[1:])))
    for file, lines in _hunks(diff or ""):
        names = [q for line in "\n".join(lines)[:500].split("\n") for q in line_queries(line)][:5]
        names = [q for q in names if len(q) < 50]
        stem = re.sub(r"\.[^.]+$", "", file.split("/")[-1])
        if names:
            found[" ".join([stem, *names] if stem else names)] = None
    snippet = "\n".join([x[1:] for x in changed if x[0] == "+"][:20])[:500]
    if len(snippet) > 50:
        found[snippet] = None
    kept = [q for q in found if 3 <= len(q) < 600]
    return sorted(kept, key=lambda q: (not re.fullmatch(r"\w+", q, re.A), len(q)))[:most]


def symbols_of_diff(diff: str | None, most: int = 20) -> list[str]:
    """Symbols of the changed lines in order, for structural lookups."""
    found: dict[str, None] = {}
    for line in (diff or "").split("\n"):
        if line[:1] not in ("+", "-") or line.startswith(("+++", "---")):
            continue
        for m in (p.search(line[1:]) for p in _SYMBOLS):
            for name in (x.strip().split(" ")[0] for x in (m[1].split(",") if m else ())):
                if len(name) >= 3 and name.lower() not in KEYWORDS:
                    found[name] = None
    return list(found)[:most]


def diff_queries(diff: Column) -> Column:
    """Array of `queries_of_diff`, in Arrow batches."""

    def run(diffs: pd.Series) -> pd.Series:
        return pd.Series([queries_of_diff(d) for d in diffs])

    return F.pandas_udf(run, "array<string>")(diff)


def diff_symbols(diff: Column) -> Column:
    """Array of `symbols_of_diff`, in Arrow batches."""

    def run(diffs: pd.Series) -> pd.Series:
        return pd.Series([symbols_of_diff(d) for d in diffs])

    return F.pandas_udf(run, "array<string>")(diff)


#: Paths and technical terms in a description, and words that are no terms.
PATH_PATTERNS = (
    r"(?i)(?:^|[\s`'\"(])([a-zA-Z0-9_\-./]+\.[a-z]{1,4})(?:[\s`'\")\]:,]|$)", r"(?i)(?:^|[\s`'\"(])((?:src|lib|pkg|packages|app|components|utils|services|api|tests?|spec)/[a-zA-Z0-9_\-./]+)(?:[\s`'\")\]:,]|$)", r"(?i)`([a-zA-Z0-9_\-./]+(?:\.[a-z]+)?)`",
)
TERM_PATTERNS = (
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z]+(?:_[a-z]+)+)\b", r"\b([A-Z]+(?:_[A-Z]+)+)\b", r"`([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)`",
    r"\b([A-Z][a-zA-Z]*(?:Handler|Service|Controller|Manager|Provider|Factory|Repository|Store|Client|Server|Middleware|Router|Validator|Parser|Builder|Resolver|Listener|Observer|Worker|Queue|Cache|Logger|Util|Helper|Config|Schema|Model|Type|Interface))\b",
)
DESCRIPTION_NOISE = frozenset(
    """the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after
    above below between under and but or nor so yet both either neither not only also just than that this these those it its we our they their i my you your what which who whom when where why how all each every
    some any no none one two three add adds added adding update updates updated updating fix fixes fixed fixing remove removes removed removing change changes changed changing make makes made making now new old
    more less most least very too pr mr wip draft todo fixme note see ref refs""".split()
)


def description_parts(text: Column) -> Column:
    """Struct of paths (10 at most), concepts (15), terms (20) and summary of a change's description; null for a blank one.

    Concepts are technical names, terms other words of four letters or more; the summary is the first paragraph that is
    no heading or list, 200 characters of it.
    """
    none = F.array().cast("array<string>")
    hits = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    noise = F.array(*map(F.lit, sorted(DESCRIPTION_NOISE)))
    words = F.array(*map(F.lit, sorted(DESCRIPTION_NOISE | NOISE_WORDS)))
    paths = F.filter(F.transform(F.flatten(F.array(*map(hits, PATH_PATTERNS))), lambda p: F.regexp_replace(p, r"[.,;:!?]+$", "")), lambda p: F.length(p) > 2)
    concepts = F.filter(F.flatten(F.array(*map(hits, TERM_PATTERNS))), lambda c: (F.length(c) >= 3) & ~F.array_contains(noise, F.lower(c)))
    bare = F.split(F.regexp_replace(F.regexp_replace(text, r"[#*`_~\[\](){}|<>]", " "), r"https?://\S+", " "), r"\s+")
    plain = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
    good = F.filter(bare, lambda w: (F.length(plain(w)) >= 4) & ~F.array_contains(words, plain(w)) & ~plain(w).rlike(r"^\d+$"))
    cleaned = F.filter(F.transform(good, lambda w: F.regexp_replace(w, "[^a-zA-Z0-9_-]", "")), lambda w: F.length(w) >= 4)
    first = F.aggregate(cleaned, F.struct(none.alias("out"), none.alias("seen")), lambda s, w: F.when(F.array_contains(s["seen"], F.lower(w)), s).otherwise(F.struct(F.array_append(s["out"], w).alias("out"), F.array_append(s["seen"], F.lower(w)).alias("seen"))), lambda s: s["out"])
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    paragraph = F.get(F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: (F.length(p) > 20) & ~p.rlike("^[#*-]")), F.lit(0))
    lead = F.coalesce(paragraph, trimmed(F.regexp_replace(text, r"[#*`_~\[\]]", "")))
    summary = F.concat(F.substring(lead, 1, 200), F.when(F.length(lead) > 200, "...").otherwise(""))
    parts = F.struct(F.slice(F.array_distinct(paths), 1, 10).alias("paths"), F.slice(F.array_distinct(concepts), 1, 15).alias("concepts"), F.slice(first, 1, 20).alias("terms"), summary.alias("summary"))
    return F.when(F.length(trimmed(text)) > 0, parts)


def description_queries(parts: Column, most: int = 8) -> Column:
    """Queries of a description: its paths and their names without extension, its concepts, and its first five terms."""
    none = F.array().cast("array<string>")
    named = lambda p: F.get(F.filter(F.transform(F.split(p, "/"), lambda x: x), lambda x: F.length(x) > 2), F.size(F.filter(F.split(p, "/"), lambda x: F.length(x) > 2)) - 1)
    stem = lambda p: F.regexp_replace(named(p), r"\.[^.]+$", "")
    each = F.flatten(F.transform(parts["paths"], lambda p: F.when(named(p).isNull(), none).when(F.length(stem(p)) > 2, F.array(p, stem(p))).otherwise(F.array(p))))
    queries = F.array_distinct(F.concat(each, parts["concepts"], F.slice(parts["terms"], 1, 5)))
    return F.slice(F.filter(F.coalesce(queries, none), lambda q: (F.length(q) >= 3) & (F.length(q) < 100)), 1, most)


def test_chunks(sources: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(source_file, id, file, score) of chunks (id, file, start, score) in test files of source files (file): an equi-join on
    the paths where a file's tests may be, the first paths and chunks first, `most` for each source. A source has a dozen such paths, so neither side is broadcast."""
    places = sources.select(F.col("file").alias("source_file"), F.posexplode(test_paths(F.col("file"))).alias("place", "file"))
    met = places.join(chunks.where(is_test_file(F.col("file"))).hint("merge"), "file")
    once = met.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("source_file", "place"))).where("_n = 1")
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy("source_file").orderBy("place", "start", "id"))).where(F.col("_r") <= most)
    return ranked.select("source_file", "id", "file", (F.col("score") * 1.5).alias("score"))


def test_paths(path: Column) -> Column:
    """Where the tests of a source file may be; none for a test file."""
    from textquarry.functions.text import base_name, parent_path, suffix

    name, folder, ext = base_name(path), parent_path(path), suffix(path)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    beside = F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(F.lit(""))
    inner = F.regexp_replace(path, "^(src|lib|pkg|packages|app)/", "")
    inner_folder = F.regexp_extract(inner, "^(.*/)[^/]*$", 1)
    python = ext == ".py"
    forms = lambda where: F.when(python, F.array(F.concat(where, stem, F.lit("_test"), ext), F.concat(where, F.lit("test_"), stem, ext))).otherwise(F.array(F.concat(where, stem, F.lit(".test"), ext), F.concat(where, stem, F.lit(".spec"), ext)))
    roots = [F.concat(F.array(F.concat(F.lit(f"{t}/"), inner_folder, name)), forms(F.concat(F.lit(f"{t}/"), inner_folder))) for t in ("test", "tests", "spec")]
    tests = F.concat(beside, F.lit("__tests__/"))
    own = F.array(F.concat(tests, name), F.concat(tests, stem, F.lit(".test"), ext), F.concat(tests, stem, F.lit(".spec"), ext))
    return F.when(is_test_file(path), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(forms(beside), own, *roots)))
