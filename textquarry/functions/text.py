"""Scalar functions over text columns, as built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def split_identifiers(c: Column) -> Column:
    """Put a space at lower-to-upper case changes and for underscores."""
    return F.replace(F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), F.lit("_"), F.lit(" "))


def tokens(c: Column, most_chars: int | None = None) -> Column:
    """Lower-case letter and digit runs in order; identifiers are split, nothing is stemmed or dropped."""
    text = F.coalesce(c, F.lit("")) if most_chars is None else F.substring(F.coalesce(c, F.lit("")), 1, most_chars)
    return F.regexp_extract_all(F.lower(split_identifiers(text)), F.lit(TOKEN), F.lit(0))


def identifier_variations(c: Column) -> Column:
    """Lower form, camel parts and their snake form, snake parts and their joined form; ordered, distinct, not empty."""
    lower = F.lower(c)
    camel = F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), r"\s+")
    snake = F.split(lower, "_")
    none = F.array().cast("array<string>")
    return F.filter(
        F.array_distinct(
            F.concat(
                F.array(lower),
                F.when(F.size(camel) > 1, F.concat(camel, F.array(F.array_join(camel, "_")))).otherwise(none),
                F.when(F.size(snake) > 1, F.concat(snake, F.array(F.array_join(snake, "")))).otherwise(none),
            )
        ),
        lambda v: v != "",
    )


def query_terms(c: Column) -> Column:
    """Distinct variations of all words of a query: any of them matches."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, identifier_variations)))


def quoted_phrases(c: Column) -> Column:
    """Texts in double or single quotes, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def without_phrases(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, "\"[^\"]+\"|'[^']+'", "")), r"\s+", " ")


def repo_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def chunk_id(*parts: Column) -> Column:
    """Deterministic id of a chunk from repository, branch, file and location."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def finding_id(feature: Column, file: Column, line: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\0", feature, file, line.cast("string"), title)), 1, 24)


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


def line_slice(c: Column, start: int | Column, n: int | Column) -> Column:
    """Lines start, start+1, ... (from 1), joined again."""
    return F.array_join(F.slice(F.split(c, "\n"), start, n), "\n")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Extension with its dot, or the empty string."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def normal_path(path: Column) -> Column:
    """Resolve "." and ".." parts; ".." at the top is dropped."""
    none = F.array().cast("array<string>")
    stack = F.aggregate(
        F.split(path, "/"),
        none,
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(stack, "/")


def strip_json_comments(c: Column) -> Column:
    """JSON text without // and /* */ comments and trailing commas."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:\"'])//.*$", "$1"), r",(\s*[}\]])", "$1")


#: Tags that open sections of a review prompt.
SECTION_TAGS = (
    "pr_mr_info", "related_code", "diff_content", "prior_findings", "finding", "feature_metadata", "file", "tests", "author_intent", "project_structure",
    "trust_boundaries", "modified", "similar", "test", "definition", "config", "import", "context", "impact", "warning", "affected_files", "cycle",
    "import_tree", "imports", "imported_by",
)


def escape_tags(c: Column, tags: tuple[str, ...] = SECTION_TAGS) -> Column:
    """Put a backslash into opening and closing tags of these names, so they close no section."""
    names = "|".join(tags)
    closed = F.regexp_replace(c, rf"(?i)</({names})([^>]*)>", r"<\\\\/$1$2>".replace("\\\\", "\\"))
    return F.regexp_replace(closed, rf"(?i)<({names})((?:\s[^>]*)?\s*/?)>", r"<\\$1$2>")


#: Escape sequences of terminals.
TERMINAL_SEQUENCES = "\\x1B\\[[0-?]*[ -/]*[@-~]|\\x1B\\][^\\x07\\x1B]*(?:\\x07|\\x1B\\\\)|\\x1B[@-Z\\\\\\-_]|\\x{9B}[0-?]*[ -/]*[@-~]|\\x{9D}[^\\x07\\x{9C}]*\\x{9C}"


def plain_terminal_text(c: Column) -> Column:
    """Without escape sequences and control characters, tab and line feed kept."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), TERMINAL_SEQUENCES, "")
    return F.regexp_replace(F.regexp_replace(out, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", ""), "[\\x{80}-\\x{9F}]", "")


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def human_tokens(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(F.concat(F.format_string("%.2f", n / 1e6), F.lit("M")))


def human_cost(c: Column) -> Column:
    return F.when(c >= 1, F.concat(F.lit("$"), F.format_string("%.2f", c))).otherwise(F.concat(F.lit("$"), F.format_string("%.4f", c)))


def clean_import_path(c: Column) -> Column:
    """Bare module name: no quotes, leading dots and slashes, or extension."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "['\"`;]", ""), r"^(\.{0,2}/)+", ""), r"\.(js|jsx|ts|tsx|py)$", "")


def named_imports(c: Column) -> Column:
    """Names in braces, without aliases."""
    inside = F.regexp_extract(c, r"\{([^}]*)\}", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_extract(F.trim(x), r"^(?:type\s+)?([^\s]+)", 1)), lambda x: x != "")


def request_number(ref: Column) -> Column:
    """Number of refs/pull/N/..., null otherwise."""
    return F.expr("try_cast(x as int)") if ref is None else F.nullif(F.regexp_extract(ref, r"^refs/pull/(\d+)/", 1), F.lit("")).cast("int")


def summary_text(c: Column, most: int = 500) -> Column:
    """At most `most` characters, cut before the last blank line or after the last full stop where that lies past the half,
    else with dots; white space at the ends goes."""
    whole = F.regexp_replace(c, r"^\s+|\s+$", "")
    head = F.substring(whole, 1, most)
    paragraph = F.length(F.regexp_extract(head, r"(?s)^(.*)\n\n", 1))
    sentence = F.length(F.regexp_extract(head, r"(?s)^(.*)\.", 1))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return (
        F.when(F.length(whole) <= most, whole)
        .when(paragraph > most // 2, trimmed(F.substring(head, F.lit(1), paragraph)))
        .when(sentence > most // 2, trimmed(F.substring(head, F.lit(1), sentence + 1)))
        .otherwise(F.concat(trimmed(head), F.lit("...")))
    )


def fence_for(c: Column) -> Column:
    """A backtick fence longer than any run in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def retry_delay_ms(attempt: Column, base: int = 1000, factor: float = 2.0, cap: int = 10_000) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(factor), attempt))


#: Messages of rate limits and timeouts, codes and statuses that a second try may mend, and how messages name a status.
RATE_LIMIT = r"(?i:usage limit)|(?i:rate[\s-]?limit)|\b429\b|(?i:too many requests)|(?i:quota.*exceeded)"
TIMEOUT = r"(?i:did not complete within)|\bETIMEDOUT\b|\bECONNRESET\b|(?i:\bsocket hang up\b)"
RETRYABLE_CODES = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "ENOTFOUND", "ENETUNREACH", "EHOSTUNREACH", "EPIPE", "EAI_AGAIN")
RETRYABLE_STATUSES = ("408", "429", "500", "502", "503", "504")
STATUS_IN_MESSAGE = r"(?i)\b(?:HTTP|status(?:\s+code)?|statusCode|response\s+status)\b[\s:=#-]*(4\d{2}|5\d{2})\b"
REASONS = "Too Many Requests|Request Timeout|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout"


def retryable_status(message: Column) -> Column:
    """Whether a message names, first of all, a status that a second try may mend."""
    named = F.regexp_extract(message, STATUS_IN_MESSAGE, 1)
    reason = rf"(?i)\b(?:(4\d{{2}}|5\d{{2}})\s+(?:{REASONS})|(?:{REASONS})[\s:=#-]+(4\d{{2}}|5\d{{2}}))\b"
    status = F.when(named != "", named).otherwise(F.concat(F.regexp_extract(message, reason, 1), F.regexp_extract(message, reason, 2)))
    return status.isin(*RETRYABLE_STATUSES)


def is_retryable(code: Column, message: Column) -> Column:
    """By the error's code, or the status that its message names."""
    return F.coalesce(code.isin(*RETRYABLE_CODES), F.lit(False)) | retryable_status(F.coalesce(message, F.lit("")))


def error_class(message: Column) -> Column:
    """rate-limit, transient, retryable or permanent."""
    m = F.coalesce(message, F.lit(""))
    return F.when(m.rlike(RATE_LIMIT), "rate-limit").when(m.rlike(TIMEOUT), "transient").when(retryable_status(m), "retryable").otherwise("permanent")


#: The hint of a fenced block by a file's extension.
LANGUAGE_HINTS = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp",
    "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c", "hpp": "cpp", "swift": "swift", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "sh": "bash", "bash": "bash",
}


def language_hint(path: Column) -> Column:
    """The hint for what follows the path's last dot, or the empty string."""
    end = F.lower(F.substring_index(path, ".", -1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_HINTS.items() for x in pair]), end), F.lit(""))
