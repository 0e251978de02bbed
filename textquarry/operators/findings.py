"""Findings: parsing, suppression, ids, lifecycle, rollups and gates."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
FINDING = "struct<severity:string,category:string,confidence:string,title:string,file:string,lineStart:int,lineEnd:int,evidence:string,problem:string,recommendation:string>"
#: Categories and confidences that a finding may have.
CATEGORIES = ("security", "correctness", "performance", "maintainability", "concurrency", "api-contract", "error-handling", "testing", "documentation", "other")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def last_block(text: Column, tag: str) -> Column:
    """Body of the last fenced block with this language tag at a line's start, or null."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?ms)^```{tag}\s*\r?\n(.*?)\r?\n```"), F.lit(1))
    return F.try_element_at(blocks, F.lit(-1))


def valid_finding(f: Column) -> Column:
    """Whether all fields are there: named values, texts that are not blank, a title of at most 200 characters, lines from 1."""
    full = lambda c: F.length(F.regexp_replace(f[c], r"^\s+|\s+$", "")) > 0
    return (
        f["severity"].isin(*SEVERITIES) & f["category"].isin(*CATEGORIES) & f["confidence"].isin(*CONFIDENCES)
        & full("title") & (F.length(F.regexp_replace(f["title"], r"^\s+|\s+$", "")) <= 200) & full("file")
        & full("evidence") & full("problem") & full("recommendation") & (f["lineStart"] > 0) & (f["lineEnd"] >= f["lineStart"])
    )


def parse_findings(reviews: DataFrame, text: str, tag: str = "findings") -> DataFrame:
    """reviews plus outcome (missing, invalid-json, schema, ok) and findings (array, empty unless ok)."""
    body = last_block(F.col(text), tag)
    parsed = F.from_json(body, f"struct<findings:array<{FINDING}>>", {"mode": "PERMISSIVE"})
    out = reviews.withColumn("_body", body).withColumn("_json", F.try_parse_json("_body")).withColumn("_found", parsed["findings"])
    ok = F.col("_found").isNotNull() & F.forall("_found", lambda f: F.coalesce(valid_finding(f), F.lit(False)))
    outcome = F.when(F.col("_body").isNull(), "missing").when(F.col("_json").isNull(), "invalid-json").when(ok, "ok").otherwise("schema")
    return out.withColumn("outcome", outcome).withColumn("findings", F.when(F.col("outcome") == "ok", F.col("_found")).otherwise(F.array().cast(f"array<{FINDING}>"))).drop("_body", "_json", "_found")


#: The parts of a review in markdown.
SUMMARY_SECTION = r"(?im)#{2,3}\s*Summary\s*\n+([\s\S]*?)(?=\n#{2,3}\s|\n---|$)"
FIRST_PARAGRAPH = r"(?m)^([^#\n][^\n]*(?:\n[^#\n][^\n]*)*)"
ISSUE_BLOCK = r"(?i)\*\*\[(?:SEVERITY:\s*)?(CRITICAL|HIGH|MEDIUM|LOW)\]\*\*\s*-?\s*([^:\n]+?):\s*([^\n]+)\n([\s\S]*?)(?=\*\*\[(?:SEVERITY:\s*)?(?:CRITICAL|HIGH|MEDIUM|LOW)\]|#{2,3}\s|---|\Z)"
PLAIN_ISSUE = r"(?i)(?:^|\n)(?:\*\*|__)?(CRITICAL|HIGH|MEDIUM|LOW)(?:\*\*|__)?[:\s-]+([^\n]+)\n([\s\S]*?)(?=\n(?:\*\*|__)?(?:CRITICAL|HIGH|MEDIUM|LOW)|#{2,3}\s|---|\Z)"
ISSUE_PLACE = r"(?i)File:\s*`?([^`\n:]+?)(?::(\d+)(?:-(\d+))?)?`?\s*\n"
ISSUE_PROBLEM = r"(?i)Problem:\s*\n?([\s\S]*?)(?=\n(?:Problematic Code|Suggested Fix|Confidence|\Z))"
ISSUE_CODE = r"(?i)Problematic Code:\s*\n```[\w]*\n([\s\S]*?)```"
ISSUE_FIX = r"(?i)Suggested Fix:\s*\n```[\w]*\n([\s\S]*?)```"
POSITIVE_SECTION = r"(?i)#{2,3}\s*Positive\s+Observations?\s*\n+([\s\S]*?)(?:\n(?=#{2,3}\s)|\Z)"
VERDICT_SECTION = r"(?i)#{2,3}\s*Final\s+Verdict\s*\n([\s\S]*)"
VERDICT = r"(?i)RECOMMENDATION:\s*(APPROVE|REQUEST_CHANGES|NEEDS_DISCUSSION)"
PLAIN_VERDICT = r"(?i)(?:RECOMMENDATION|Verdict|Decision):\s*(APPROVE|REQUEST_CHANGES|NEEDS_DISCUSSION)"
MERGE = r"(?i)Merge\s*Decision:\s*(SAFE[_\s]?TO[_\s]?MERGE|DO[_\s]?NOT[_\s]?MERGE|CONDITIONAL[_\s]?MERGE)"
LEVEL = r"(?i)Confidence\s*(?:Level)?:\s*(HIGH|MEDIUM|LOW)"
RATIONALE = r"(?is)Rationale:\s*(.+?)(?=\n\n|\nIssues|\Z)"
COUNTS = r"(?i)(\d+)\s*CRITICAL,?\s*(\d+)\s*HIGH,?\s*(\d+)\s*MEDIUM,?\s*(\d+)\s*LOW"
MERGES = {"APPROVE": "SAFE_TO_MERGE", "REQUEST_CHANGES": "DO_NOT_MERGE", "NEEDS_DISCUSSION": "CONDITIONAL_MERGE"}
REVIEW = (
    "struct<summary:string,issues:array<struct<severity:string,category:string,title:string,file:string,line:int,end_line:int,description:string,code:string,suggestion:string,confidence:string>>,"
    "positives:array<string>,recommendation:string,confidence:string,merge:string,rationale:string,critical:int,high:int,medium:int,low:int>"
)


def _first(pattern: str, text: str, group: int = 1) -> str | None:
    m = re.search(pattern, text)
    return m[group] if m else None


def _issue(severity: str, category: str, title: str, body: str) -> dict:
    place = re.search(ISSUE_PLACE, body)
    lead = body.split("\n\n")[0].strip()
    described = (_first(ISSUE_PROBLEM, body) or "").strip() or ("" if lead.startswith("```") else lead)
    strip = lambda x: None if x is None else x.strip()
    return {
        "severity": severity.upper(), "category": category.strip(), "title": title.strip(), "file": place and place[1].strip(), "line": place and place[2] and int(place[2]), "end_line": place and place[3] and int(place[3]),
        "description": described or title.strip(), "code": strip(_first(ISSUE_CODE, body)), "suggestion": strip(_first(ISSUE_FIX, body)), "confidence": (_first(LEVEL, body) or "MEDIUM").upper(),
    }


def review_issues(text: str) -> list[dict]:
    """Issue blocks; where none has the marked form, blocks that a bare severity opens."""
    marked = [_issue(*m.groups()) for m in re.finditer(ISSUE_BLOCK, text)]
    if marked:
        return marked
    out = []
    for severity, line, body in (m.groups() for m in re.finditer(PLAIN_ISSUE, text)):
        head, colon, rest = line.partition(":")
        named = bool(colon) and 0 < len(head) < 50
        out.append(_issue(severity, head if named else "General", rest if named else line, body))
    return [x for x in out if x["title"]]


def review_positives(text: str) -> list[str]:
    """Bullets of the section of positive observations, or its first five long lines."""
    lines = (_first(POSITIVE_SECTION, text) or "").split("\n")
    bullets = [m[1].strip() for m in (re.match(r"\s*[-*•]\s+(.+)", x) for x in lines) if m]
    return [b for b in bullets if len(b) > 5] or [x.strip() for x in lines if len(x.strip()) > 10][:5]


def review_of(text: str | None) -> dict | None:
    """Summary, issues, positives and verdict of a review in markdown; null where it has none of summary, issues and verdict."""
    if not text:
        return None
    summary = (_first(SUMMARY_SECTION, text) or "").strip()
    lead = (_first(FIRST_PARAGRAPH, text) or "").strip()
    if not summary and 20 < len(lead) < 1000 and "```" not in lead:
        summary = lead
    issues, section = review_issues(text), _first(VERDICT_SECTION, text)
    plain = None if section is not None else _first(PLAIN_VERDICT, text)
    if not summary and not issues and section is None and plain is None:
        return None
    counts = re.search(COUNTS, section or "")
    merge = re.sub(r"[\s_]", "", (_first(MERGE, section if section is not None else text) or "").upper())
    merge = "SAFE_TO_MERGE" if merge.startswith("SAFE") else "DO_NOT_MERGE" if merge.startswith("DO") else "CONDITIONAL_MERGE" if merge or section is not None else MERGES.get((plain or "").upper(), "CONDITIONAL_MERGE")
    confidence = (_first(LEVEL, section) or "MEDIUM").upper() if section is not None else "MEDIUM" if plain else "LOW"
    rationale = (_first(RATIONALE, section) or "").strip() if section is not None else "" if plain else "Could not parse verdict from review"
    return {
        "summary": summary or "No summary provided", "issues": issues, "positives": review_positives(text), "recommendation": ((_first(VERDICT, section) if section is not None else plain) or "NEEDS_DISCUSSION").upper(),
        "confidence": confidence, "merge": merge, "rationale": rationale, **{k: int(counts[i]) if counts else None for i, k in enumerate(("critical", "high", "medium", "low"), 1)},
    }


def parse_review(text: Column) -> Column:
    """The struct of `review_of`, in Arrow batches: a review's parts are found one after the other."""

    def run(texts: pd.Series) -> pd.DataFrame:
        none = {k: None for k in ("summary", "issues", "positives", "recommendation", "confidence", "merge", "rationale", "critical", "high", "medium", "low")}
        rows = [review_of(t) or none for t in texts]
        out = pd.DataFrame(rows, columns=list(none))
        return out.astype({k: "Int32" for k in ("critical", "high", "medium", "low")})

    return F.pandas_udf(run, REVIEW)(text)


def suppressed(findings: DataFrame, files: DataFrame, mark: str = "review: ignore") -> DataFrame:
    """Findings (file, lineStart, ...) without those marked on their line, the line above, or for the whole file.

    files: (file, content). Only marked lines leave the scan of the contents.
    """
    whole = files.where(F.col("content").rlike(rf"{mark}-file")).select("file").distinct()
    lines = files.where(F.col("content").rlike(mark)).select("file", F.posexplode(F.split("content", "\n")).alias("p", "line")).where(F.col("line").rlike(rf"{mark}(?!-file)"))
    at = lines.select("file", F.explode(F.array(F.col("p") + 1, F.col("p") + 2)).alias("lineStart")).distinct()
    return findings.join(at, ["file", "lineStart"], "left_anti").join(whole, "file", "left_anti")


#: An issue block of a review, its place, and the line that counts the issues.
SEVERITY_BLOCK = r"(?s)\*\*\[SEVERITY:\s*(?:CRITICAL|HIGH|MEDIUM|LOW)\]\*\*.*?(?=\n\*\*\[SEVERITY|\n### |\nIssues Summary:|\nRECOMMENDATION:|$)"
BLOCK_SEVERITY = r"\*\*\[SEVERITY:\s*(CRITICAL|HIGH|MEDIUM|LOW)\]\*\*"
BLOCK_PLACE = r"File:\s*([^\s:]+):(\d+)"
SUMMARY_LINE = r"(?i)Issues Summary:\s*(\d+)\s*CRITICAL,\s*(\d+)\s*HIGH,\s*(\d+)\s*MEDIUM,\s*(\d+)\s*LOW"


def drop_suppressed_blocks(reviews: DataFrame, text: str, key: str, files: DataFrame, mark: str = "review: ignore") -> DataFrame:
    """(key, review, n_suppressed): reviews without the issue blocks whose line is marked, with the counts of the summary
    line lowered by them (not below zero). Blocks that name no file and line stay."""
    each = reviews.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SEVERITY_BLOCK), F.lit(0))).alias("n", "block"))
    each = each.withColumn("file", F.regexp_extract("block", BLOCK_PLACE, 1)).withColumn("lineStart", F.nullif(F.regexp_extract("block", BLOCK_PLACE, 2), F.lit("")).cast("int")).withColumn("severity", F.regexp_extract("block", BLOCK_SEVERITY, 1))
    gone = each.join(suppressed(each, files, mark).select(key, "n"), [key, "n"], "left_anti").where("file <> ''")
    dropped = gone.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "block", "severity"))).alias("gone"))
    without = F.aggregate("gone", F.col(text), lambda out, x: F.replace(out, x["block"], F.lit("")))  # equal blocks name the same line
    left = lambda i, s: F.greatest(F.lit(0), F.regexp_extract(text, SUMMARY_LINE, i).cast("int") - F.size(F.filter("gone", lambda x: x["severity"] == s))).cast("string")
    line = F.concat(F.lit("Issues Summary: "), left(1, "CRITICAL"), F.lit(" CRITICAL, "), left(2, "HIGH"), F.lit(" HIGH, "), left(3, "MEDIUM"), F.lit(" MEDIUM, "), left(4, "LOW"), F.lit(" LOW"))
    counted = F.when(F.col(text).rlike(SUMMARY_LINE), F.regexp_replace(without, F.lit(SUMMARY_LINE), line)).otherwise(without)
    n = F.size("gone")
    note = F.concat(F.rtrim(F.regexp_replace(counted, r"\s+$", "")), F.lit("\n\nSuppressed: "), n.cast("string"), F.when(n == 1, " finding").otherwise(" findings"), F.lit(f" via `{mark}` markers.\n"))
    joined = reviews.select(key, text).join(dropped, key, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<n:int,block:string,severity:string>>")))
    return joined.select(key, F.when(n > 0, note).otherwise(counted).alias("review"), n.alias("n_suppressed"))


def severity_rollup(findings: DataFrame, severity: str, by: list[str] | None = None) -> DataFrame:
    """Counts of the four severities, zero where none, and their total."""
    counts = [F.count_if(F.col(severity) == s).alias(s.lower()) for s in SEVERITIES]
    return findings.groupBy(*(by or [])).agg(*counts, F.count("*").alias("total"))


def latest_statuses(findings: DataFrame, verdicts: DataFrame, gone: DataFrame | None = None, by: tuple[str, ...] = ("feature", "persona")) -> DataFrame:
    """findings (finding_id, status) with verdicts (finding_id, verdict) applied; without a verdict nothing changes.

    Unresolved findings of a feature and persona that are `gone` cannot be judged any more and become uncertain.
    """
    new = F.when(F.col("verdict") == "fixed", "fixed").when(F.col("verdict") == "still-present", "open").when(F.col("verdict") == "uncertain", "uncertain").otherwise(F.col("status"))
    out = findings.join(verdicts, "finding_id", "left").withColumn("status", new)
    if gone is None:
        return out
    keys = [k for k in by if k in gone.columns]
    lost = out.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), keys, "left")
    return lost.withColumn("status", F.when(F.col("_gone") & F.col("status").isin("open", "uncertain"), "uncertain").otherwise(F.col("status"))).drop("_gone")


def merge_by_title(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Findings (title, seq, ...) of both; of equal titles a fresh one wins, among fresh ones the last."""
    both = prior.withColumn("is_fresh", F.lit(0)).unionByName(fresh.withColumn("is_fresh", F.lit(1)))
    w = Window.partitionBy("title").orderBy(F.desc("is_fresh"), F.desc("seq"))
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def surviving(prior: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Prior findings (title) that a verdict confirms, or that no verdict names."""
    present = verdicts.where(F.col("verdict") == "still-present").select("title")
    return prior.join(present, "title", "left_semi").unionByName(prior.join(verdicts.select("title"), "title", "left_anti"))


def verdict_for_approval(verdict: Column, critical: Column, high: Column) -> Column:
    return F.when((verdict == "APPROVE") & ((critical > 0) | (high > 0)), "NEEDS_DISCUSSION").otherwise(verdict)


def usage_totals(messages: DataFrame, role: str, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of the usage fields over assistant messages, null as 0, and how many there were."""
    return messages.where(F.col(role) == "assistant").groupBy(*(by or [])).agg(*[F.sum(F.coalesce(F.col(f), F.lit(0))).alias(f) for f in fields], F.count("*").alias("messages"))


def touched_features(features: DataFrame, touched: DataFrame) -> DataFrame:
    """Features (feature_id, owned array) that own a touched file (file)."""
    owned = features.select("feature_id", F.explode("owned").alias("file"))
    return features.join(owned.join(touched, "file", "left_semi").select("feature_id").distinct(), "feature_id", "left_semi")
