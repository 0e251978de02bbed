"""Predicates and classifications over paths, queries and findings, as built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import base_name, suffix

#: Extensions that are indexed, with their languages, and folders that are not.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".rs": "rust", ".go": "go", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".md": "markdown",
}
EXCLUDED_FOLDERS = ("node_modules", "dist", "build", ".git", "target", "__pycache__", "venv", ".venv", "vendor", ".next", "coverage", ".nyc_output", ".pytest_cache")

#: Path parts that are or may be secrets, and those that are samples of them.
SENSITIVE_PARTS = (
    ".env", ".env.local", ".env.development", ".env.production", ".env.test", ".ssh", ".aws", ".pem", ".gnupg", ".docker", ".npmrc", ".pypirc",
    "application.properties", "application.yml", "application.yaml",
)
SAFE_PARTS = (".env.example", ".env.sample", ".env.template")
KEY_EXTENSIONS = (".pem", ".key", ".p12", ".pfx", ".crt", ".cer")
KEY_NAMES = ("id_rsa", "id_ed25519", "id_ecdsa", "id_dsa")
PROFILE_FILE = r"^application-[\w-]+\.(properties|ya?ml)$"
ACCOUNT_FILE = r"(^|[-_.])service[-_]?account.*\.json$"
CREDENTIAL_FILE = r"(^|[-_.])credentials?\.json$"

#: Path patterns and the trust boundaries that they stand for.
BOUNDARY_RULES = (
    (r"(?i)(^|/)(routes?|controllers?|handlers?|api|endpoints?)/", ("network", "user-input")),
    (r"(?i)/route\.(t|j)sx?$", ("network", "user-input")),
    (r"(?i)/(webhook|callback)s?/", ("network", "user-input")),
    (r"(?i)(^|/)(auth|session|oauth|saml|sso)(/|\.)", ("auth", "secrets")),
    (r"(?i)(^|/)(crypto|jwt|token|secret|password|credential)s?(/|\.)", ("secrets",)),
    (r"(?i)(^|/)permissions?(/|\.)", ("permissions", "auth")),
    (r"(?i)(^|/)(db|database|models?|repositor(y|ies)|migrations?|schema)(/|\.)", ("database",)),
    (r"(?i)\.(sql|prisma)$", ("database",)),
    (r"(?i)(^|/)(exec|shell|subprocess|spawn)(/|\.)", ("process-exec",)),
    (r"(?i)(^|/)(fs|filesystem|storage|uploads?)(/|\.)", ("filesystem",)),
    (r"(?i)(^|/)(serializ|deserializ|parser|marshal|unmarshal)", ("serialization",)),
    (r"(?i)(^|/)(client|sdk|integration)s?/", ("external-api",)),
)
SECURITY_BOUNDARIES = ("user-input", "network", "serialization", "external-api", "auth", "permissions", "secrets")

#: Names and folders of test files.
TEST_FOLDERS = r"__tests__/|/tests/|/test/|/spec/|^tests/|^test/|^spec/"
TEST_NAMES = r"\.test\.|\.spec\.|_test\.|\.tests\.|\.specs\."

#: Configuration files by name.
CONFIG_TYPES = (
    (r"^tsconfig.*\.json$", "tsconfig"),
    (r"^\.eslintrc(\.(json|js|cjs|ya?ml))?$|^eslint\.config\.", "eslint"),
    (r"^package\.json$", "package_json"),
    (r"^pyproject\.toml$", "pyproject"),
    (r"^go\.mod$", "go_mod"),
    (r"^Cargo\.toml$", "cargo"),
)
VERBS = "get|set|is|has|can|should|create|update|delete|remove|add|find|fetch|load|save|parse|format|validate|handle|process|build|make|init|run|execute|render|on|to|from"


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(suffix(path)))


def is_indexable(path: Column) -> Column:
    parts = F.split(path, "/")
    return language_of(path).isNotNull() & ~F.exists(parts, lambda p: p.isin(*EXCLUDED_FOLDERS))


def is_sensitive(path: Column) -> Column:
    """Any part of the path, in lower case, is a secret by its name; sample files are not."""

    def bad(p: Column) -> Column:
        key = ~p.endswith(".pub") & reduce(lambda a, b: a | b, [p.endswith(e) for e in KEY_EXTENSIONS])
        named = p.isin(*SENSITIVE_PARTS) | p.startswith(".env.") | p.rlike(PROFILE_FILE) | key | p.isin(*KEY_NAMES) | p.rlike(ACCOUNT_FILE) | p.rlike(CREDENTIAL_FILE)
        return ~p.isin(*SAFE_PARTS) & named

    return F.exists(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), bad)


def is_test_file(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.rlike(TEST_FOLDERS) | p.rlike(TEST_NAMES) | base_name(p).startswith("test_")


def config_type(path: Column) -> Column:
    name = base_name(path)
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(CONFIG_TYPES):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def trust_boundaries(path: Column) -> Column:
    """Sorted distinct boundaries that a path touches."""
    none = F.array().cast("array<string>")
    hits = [F.when(path.rlike(r), F.array(*map(F.lit, tags))).otherwise(none) for r, tags in BOUNDARY_RULES]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*hits))))


def personas(kind: Column, boundaries: Column, has_tests: Column) -> Column:
    """Reviewers of a feature in their fixed order."""
    return F.array_compact(
        F.array(
            F.lit("general"),
            F.when(kind.isin("library", "service"), F.lit("architect")),
            F.when(F.arrays_overlap(boundaries, F.array(*map(F.lit, SECURITY_BOUNDARIES))), F.lit("security")),
            F.when((kind == "test-suite") | has_tests, F.lit("test-auditor")),
        )
    )


def is_unresolved(status: Column) -> Column:
    return status.isin("open", "uncertain")


def is_pending(status: Column) -> Column:
    return status.isin("pending", "error")


def is_function_like(symbol: Column) -> Column:
    """Longer than two characters and not a capitalised noun, unless it starts with a verb."""
    return (F.length(symbol) > 2) & (~symbol.rlike("^[A-Z][a-z]+([A-Z][a-z]+)*$") | symbol.rlike(f"^(?i)({VERBS})[A-Z_]"))


def wants_keywords(query: Column) -> Column:
    """Looks like code, or is short."""
    return query.rlike("[._]") | query.rlike("[a-z][A-Z]") | query.rlike("[\"']") | (F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) <= 3)


def is_dynamic(metadata: Column) -> Column:
    """Of a JSON text: is_dynamic or is_lazy is true, or the word dynamic stands in it."""
    true = lambda k: F.coalesce(F.get_json_object(metadata, f"$.{k}") == "true", F.lit(False))
    return true("is_dynamic") | true("is_lazy") | F.lower(metadata).contains("dynamic")


def same_file(a: Column, b: Column) -> Column:
    """Equal, or one path ends with the other."""
    return a.endswith(b) | b.endswith(a)


def overlaps(start: Column, end: Column, line: Column) -> Column:
    return line.between(start, end)


def chunk_category(is_modified: Column, is_test: Column, from_definition: Column, code: Column) -> Column:
    lower = F.lower(code)
    typed = reduce(lambda a, b: a | b, [lower.contains(w) for w in ("interface ", "type ", "class ", "struct ", "enum ", "typedef ")])
    return F.when(is_modified, "modified").when(is_test, "test").when(from_definition | typed, "type_definition").otherwise("similar")


def severity_order(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "HIGH", 1).when(severity == "MEDIUM", 2).otherwise(3)


def hub_severity(n: Column) -> Column:
    return F.when(n >= 20, "critical").when(n >= 10, "high").otherwise("medium")


def ci_exit_code(critical: Column, high: Column, fail_on: Column) -> Column:
    return F.when(((fail_on == "critical") & (critical > 0)) | ((fail_on == "high") & ((critical > 0) | (high > 0))), 1).otherwise(0)

