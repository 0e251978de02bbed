"""Chunks, symbols, imports and calls of source files.

Python files are parsed exactly; brace languages go through a small lexer that blanks strings and comments and matches
braces. Both run in Arrow batches over one file at a time; the line fallback and configuration files stay in expressions.
"""

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "array<struct<location:string,code:string,start_line:int,end_line:int,chunk_type:string,symbol_names:array<string>>>"
CALL = "array<struct<callee:string,receiver:string,is_method:boolean,line:int,is_dynamic:boolean>>"
DEFINITION = "array<struct<symbol:string,kind:string,start_line:int,end_line:int>>"
NESTED_LINES = 50


def line_chunks(files: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, location, start_line, end_line, code): windows of `size` lines that share `overlap`; the last ends the file."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(1), n, F.lit(step)), lambda s: (s == 1) | (s + overlap <= n))
    each = files.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(key, lines.alias("_l"), F.explode(starts).alias("start_line"))
    end = F.least(F.col("start_line") + size - 1, F.size("_l"))
    return each.select(key, F.concat_ws("-", "start_line", end).alias("location"), F.col("start_line").cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.array_join(F.slice("_l", F.col("start_line"), size), "\n").alias("code"))


_DEFINE = re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:pub(?:\([^)]*\))?\s+)?(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|async\s+|final\s+)*(function\*?|class|interface|struct|enum|trait|impl|fn|func|type|namespace|module)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)", re.M)
_ARROW = re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>", re.M)
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*)(\.|::|\?\.))?([A-Za-z_$][\w$]*)\s*\(")
#: Words before a parenthesis that are no calls.
NOT_CALLED = frozenset("if for while switch catch return function func fn def class new typeof sizeof await async match loop with elif except lambda super import".split())


def blank_noise(code: str) -> str:
    """Strings and comments as spaces, line feeds kept, so offsets stay."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _brace_units(code: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, name, start_line, end_line, depth) of definitions with a braced body or a statement end."""
    clean = blank_noise(code)
    out = []
    found = sorted([(m.start(), m[1], m[2]) for m in _DEFINE.finditer(clean)] + [(m.start(), "function", m[1]) for m in _ARROW.finditer(clean)])
    for at, kind, name in found:
        brace, end = clean.find("{", at), clean.find(";", at)
        stop = len(clean)
        if brace != -1 and (end == -1 or brace < end):
            depth = 0
            for i in range(brace, len(clean)):
                depth += (clean[i] == "{") - (clean[i] == "}")
                if not depth:
                    stop = i + 1
                    break
        elif end != -1:
            stop = end + 1
        depth = clean.count("{", 0, at) - clean.count("}", 0, at)
        kind = {"fn": "function", "func": "function", "function*": "function"}.get(kind, kind)
        out.append((kind, name, code.count("\n", 0, at + len(clean[at:]) - len(clean[at:].lstrip())) + 1, code.count("\n", 0, stop) + 1, depth))
    return out


def _python_units(code: str) -> list[tuple[str, str, int, int, int]]:
    out = []

    def walk(body: list, depth: int) -> None:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                out.append(("class" if isinstance(x, ast.ClassDef) else "function", x.name, first, x.end_lineno or x.lineno, depth))
                walk(x.body, depth + 1)

    walk(ast.parse(code).body, 0)
    return out


def units(code: str, language: str | None) -> list[tuple[str, str, int, int, int]]:
    return _python_units(code) if language == "python" else _brace_units(code)


def chunk_source(code: str | None, language: str | None) -> list[dict]:
    """Top-level units with leading comments, long members besides, stretches between as "other", else one "module"."""
    if not code or not code.strip():
        return []
    lines = code.split("\n")
    try:
        found = units(code, language)
    except (SyntaxError, ValueError, RecursionError):
        found = None
    if found is None:
        step, out, start = 450, [], 1
        while start == 1 or start + 50 <= len(lines):
            out.append(_chunk(lines, start, min(start + 499, len(lines)), "fallback", []))
            start += step
        return out
    top = [u for u in found if u[4] == 0]
    out, covered = [], []
    for kind, name, a, b, _ in top:
        first = a
        while first > 1 and lines[first - 2].strip().startswith(("#", "//", "*", "/*", "@")):
            first -= 1
        inner = [u[1] for u in found if u[4] > 0 and a <= u[2] and u[3] <= b]
        out.append(_chunk(lines, first, b, kind, [name, *inner]))
        covered.append((first, b))
        out += [_chunk(lines, c, d, "method", [n]) for k, n, c, d, deep in found if deep == 1 and a <= c and d <= b and d - c + 1 >= NESTED_LINES]
    reach = 0
    for a, b in [*sorted(covered), (len(lines) + 1, len(lines) + 1)]:
        if top and a > reach + 1 and "".join(lines[reach : a - 1]).strip():
            out.append(_chunk(lines, reach + 1, a - 1, "other", []))
        reach = max(reach, b)
    return out or [_chunk(lines, 1, len(lines), "module", [])]


def _chunk(lines: list[str], a: int, b: int, kind: str, names: list[str]) -> dict:
    return {"location": f"{a}-{b}", "code": "\n".join(lines[a - 1 : b]), "start_line": a, "end_line": b, "chunk_type": kind, "symbol_names": names}


def chunk_file(code: Column, language: Column) -> Column:
    def run(codes: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([chunk_source(c, g) for c, g in zip(codes, languages)])

    return F.pandas_udf(run, CHUNK)(code, language)


def file_definitions(code: Column, language: Column) -> Column:
    def one(c: str | None, g: str | None) -> list[dict]:
        try:
            return [{"symbol": n, "kind": k, "start_line": a, "end_line": b} for k, n, a, b, _ in units(c or "", g)]
        except (SyntaxError, ValueError, RecursionError):
            return []

    def run(codes: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([one(c, g) for c, g in zip(codes, languages)])

    return F.pandas_udf(run, DEFINITION)(code, language)


def calls_in(code: str | None, language: str | None) -> list[dict]:
    if not code:
        return []
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            return []
        out = []
        for x in ast.walk(tree):
            if not isinstance(x, ast.Call):
                continue
            f = x.func
            if isinstance(f, ast.Name):
                out.append({"callee": f.id, "receiver": None, "is_method": False, "line": x.lineno, "is_dynamic": f.id in ("getattr", "eval", "exec")})
            elif isinstance(f, ast.Attribute):
                out.append({"callee": f.attr, "receiver": ast.unparse(f.value), "is_method": True, "line": x.lineno, "is_dynamic": False})
        return sorted(out, key=lambda c: (c["line"], c["callee"]))
    if language not in ("javascript", "typescript", "go", "java", "rust"):
        return []
    clean = blank_noise(code)
    defined = {m.start(2) for m in _DEFINE.finditer(clean)}
    out = []
    for m in _CALL.finditer(clean):
        if m[3] not in NOT_CALLED and m.start(3) not in defined:
            out.append({"callee": m[3], "receiver": m[1], "is_method": bool(m[1]), "line": code.count("\n", 0, m.start(3)) + 1, "is_dynamic": False})
    return out


def file_calls(code: Column, language: Column) -> Column:
    def run(codes: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([calls_in(c, g) for c, g in zip(codes, languages)])

    return F.pandas_udf(run, CALL)(code, language)


#: Import statements by language, group 1 the module.
IMPORT_PATTERNS = {
    "python": (r"(?m)^\s*from\s+([\w.]+)\s+import\b", r"(?m)^\s*import\s+([\w.]+)"),
    "javascript": (r"\bfrom\s+['\"]([^'\"]+)['\"]", r"(?m)^\s*import\s+['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    "go": (r"(?m)^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", r"(?m)^\s*(?:\w+\s+)?\"([\w./-]+)\"\s*$"),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",),
    "rust": (r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",),
    "c": (r"(?m)^\s*#include\s+[<\"]([^>\"]+)[>\"]",),
}
IMPORT_PATTERNS |= {"typescript": IMPORT_PATTERNS["javascript"], "cpp": IMPORT_PATTERNS["c"]}
EXPORT_PATTERN = r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"


def imports_of(code: Column, language: Column) -> Column:
    """Sorted distinct modules that a file imports."""
    out = F.array().cast("array<string>")
    for name, patterns in IMPORT_PATTERNS.items():
        hits = F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in patterns]))
        out = F.when(language == name, F.array_sort(F.array_distinct(hits))).otherwise(out)
    return out


def exports_of(code: Column, language: Column) -> Column:
    """Sorted distinct exported names: export statements, or the strings of __all__."""
    listed = F.regexp_extract_all(F.regexp_extract(code, r"(?s)__all__\s*=\s*[\[(](.*?)[\])]", 1), F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    braces = F.filter(F.transform(F.flatten(F.transform(F.regexp_extract_all(code, F.lit(r"(?m)^\s*export\s*\{([^}]*)\}"), F.lit(1)), lambda b: F.split(b, ","))), lambda x: F.regexp_extract(F.trim(x), r"(\S+)$", 1)), lambda x: x != "")
    names = F.concat(F.regexp_extract_all(code, F.lit(EXPORT_PATTERN), F.lit(1)), braces)
    return F.when(language == "python", F.array_sort(F.array_distinct(listed))).otherwise(F.array_sort(F.array_distinct(names)))


def symbols_in_range(definitions: Column, start: Column, end: Column) -> Column:
    """Names of the definitions (see file_definitions) that start within the lines."""
    return F.array_distinct(F.transform(F.filter(definitions, lambda d: d["start_line"].between(start, end)), lambda d: d["symbol"]))


def config_metadata(content: Column, kind: Column) -> Column:
    """Struct of strict_mode, target, dependencies, dev_dependencies, rules and extends (with plugins) of tsconfig, package, pyproject, go.mod, Cargo and eslint files."""
    from textquarry.functions.text import strip_json_comments

    json = strip_json_comments(content)
    keys = lambda p: F.coalesce(F.array_sort(F.map_keys(F.from_json(F.get_json_object(json, p), "map<string,string>"))), F.array().cast("array<string>"))
    listed = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(p), F.lit(1))))
    under = lambda section: F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_extract(content, rf"(?s)(?:^|\n)\[{section}\][^\n]*\n(.*?)(?=\n\[|\z)", 1), F.lit(r"(?m)^([\w-]+)\s*="), F.lit(1))))
    none = F.array().cast("array<string>")
    return F.struct(
        kind.alias("config_type"),
        F.when(kind == "tsconfig", F.get_json_object(json, "$.compilerOptions.strict").cast("boolean")).alias("strict_mode"),
        F.when(kind == "tsconfig", F.get_json_object(json, "$.compilerOptions.target")).when(kind == "go_mod", F.nullif(F.regexp_extract(content, r"(?m)^go\s+(\S+)", 1), F.lit(""))).when(kind == "cargo", F.nullif(F.regexp_extract(content, r"(?m)^edition\s*=\s*\"([^\"]+)\"", 1), F.lit(""))).alias("target_version"),
        F.when(kind == "package_json", keys("$.dependencies")).when(kind == "go_mod", listed(r"(?m)^\s+([\w./-]+)\s+v[\d.]+")).when(kind == "cargo", under("dependencies")).when(kind == "pyproject", listed(r"(?m)^\s*\"([A-Za-z][\w.-]*)[^\"]*\",?\s*$")).otherwise(none).alias("dependencies"),
        F.when(kind == "package_json", keys("$.devDependencies")).when(kind == "cargo", under("dev-dependencies")).otherwise(none).alias("dev_dependencies"),
        F.when(kind == "eslint", keys("$.rules")).otherwise(none).alias("rules"),
        F.when(kind == "eslint", F.array_sort(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", F.get_json_object(json, "$.extends"), F.get_json_object(json, "$.plugins")), F.lit(r"[@\w./:-]+"), F.lit(0))))).otherwise(none).alias("extends"),
    )


def path_tree(paths: DataFrame, path: str, depth: int = 4) -> DataFrame:
    """(node, level, is_folder, n_files): all path prefixes down to `depth`, folders before files by name."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), i.cast("int").alias("level"), (i < F.size(parts)).alias("is_folder")))
    return paths.select(F.inline(upto)).groupBy("node", "level").agg(F.bool_or("is_folder").alias("is_folder"), F.count("*").alias("n_files"))


def tree_lines(paths: DataFrame, path: str, marked: str, depth: int = 4, most: int = 50) -> DataFrame:
    """(position, node, level, is_folder, is_marked): the lines of a tree of paths down to `depth`: at each level what is marked
    or holds it first, then folders, then by name; the first `most` lines."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.slice(parts, 1, i).alias("node"), i.cast("int").alias("level"), (i < F.size(parts)).alias("is_folder")))
    nodes = paths.select(F.col(marked).alias("_m"), F.inline(upto)).groupBy("node", "level").agg(F.bool_or("is_folder").alias("is_folder"), F.bool_or("_m").alias("is_marked"))
    # A node's place is that of its ancestors and itself, one after the other.
    step = F.struct((~F.col("a.is_marked")).alias("m"), (~F.col("a.is_folder")).alias("f"), F.element_at("a.node", -1).alias("n"), F.col("a.level").alias("l"))
    above = nodes.select("node", "level", "is_folder", "is_marked", F.explode(F.transform(F.sequence(F.lit(1), "level"), lambda i: F.slice("node", 1, i))).alias("up")).alias("x")
    placed = above.join(nodes.alias("a"), F.col("x.up") == F.col("a.node")).groupBy("x.node", "x.level", "x.is_folder", "x.is_marked").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("a.level").alias("l"), step.alias("s")))), lambda y: y["s"]).alias("place"))
    first = placed.orderBy("place").limit(most)
    return first.select(F.row_number().over(Window.orderBy("place")).alias("position"), F.array_join("node", "/").alias("node"), "level", "is_folder", "is_marked")
