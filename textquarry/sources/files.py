"""Sources and sinks: file trees, change sets, logs, JSON records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textquarry.functions.predicates import LANGUAGES, is_indexable, language_of

MOST_BYTES = 10_000_000
#: Lines of a report that are put together at once.
PIECE_LINES = 50_000


def source_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file, content, language, size, last_modified) of indexable files; names and sizes are filtered before reading."""
    glob = "*{" + ",".join(LANGUAGES) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    file = F.regexp_replace("path", rf"^.*?{base}/", "")
    kept = raw.where(F.col("length") <= most_bytes).withColumn("file", file).where(is_indexable(F.col("file")))
    return kept.select("file", F.decode("content", "UTF-8").alias("content"), language_of(F.col("file")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def glob_to_regex(glob: str) -> str:
    """Regular expression of a glob with *, ? and **."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def matches_globs(path: Column, included: list[str], excluded: list[str]) -> Column:
    """One alternation each for the patterns that include and exclude."""
    any_of = lambda gs: "|".join(map(glob_to_regex, gs))
    out = path.rlike(any_of(included)) if included else F.lit(True)
    return out & ~path.rlike(any_of(excluded)) if excluded else out


def table_slice(table: DataFrame, repo: str | None = None, branch: str | None = None, repo_column: str = "repo_id", branch_column: str = "branch") -> DataFrame:
    """Optional equality filters; on tables partitioned by these columns they prune partitions."""
    if repo is not None:
        table = table.where(F.col(repo_column) == repo)
    return table if branch is None else table.where(F.col(branch_column) == branch)


def change_set(lines: DataFrame, line: str = "value") -> DataFrame:
    """(seq, change, path): name-status lines ("A<tab>path", "R100<tab>old<tab>new") or "A:path"; a bare path is M; a
    rename is a deletion and an addition; other codes are dropped."""
    text = F.trim(F.col(line))
    tab, colon = F.split(text, "\t"), F.regexp_extract_all(text, F.lit("^([AMDR]):(.+)$"), F.lit(2))
    code = F.when(text.contains("\t"), F.substring(text, 1, 1)).when(F.size(colon) > 0, F.substring(text, 1, 1)).otherwise("M")
    path = F.when(text.contains("\t"), F.get(tab, F.lit(1))).when(F.size(colon) > 0, F.get(colon, F.lit(0))).otherwise(text)
    rows = lines.where(text != "").select(code.alias("c"), path.alias("p"), F.get(tab, F.lit(2)).alias("q"))
    one = lambda c, p: F.array(F.struct(F.lit(c).alias("change"), p.alias("path")))
    each = F.when(F.col("c").isin("A", "M", "D"), F.array(F.struct(F.col("c").alias("change"), F.col("p").alias("path")))).when((F.col("c") == "R") & F.col("q").isNotNull(), F.concat(one("D", F.col("p")), one("A", F.col("q"))))
    return rows.select(F.inline(each))


def commit_fields(records: DataFrame, record: str = "value") -> DataFrame:
    """(sha, author, date, subject) of records whose fields end with 0x1f; blank records are dropped."""
    parts = F.split(F.regexp_replace(record, r"^\s+", ""), "\x1f")
    return records.where(F.trim(record) != "").select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("sha", "author", "date", "subject"))])


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a log file whose records end with 0x1e."""
    return commit_fields(spark.read.option("lineSep", "\x1e").text(path))


def parsed_records(rows: DataFrame, body: str, schema: str) -> DataFrame:
    """Columns of a JSON text by an explicit schema; rows whose text is malformed are skipped."""
    parsed = rows.where(F.try_parse_json(F.col(body)).isNotNull()).withColumn("_r", F.from_json(F.col(body), schema))
    return parsed.select("_r.*")


def json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One record a file; malformed ones are skipped. No inference."""
    bad = StructField("_corrupt", StringType())
    raw = spark.read.schema(StructType([*schema.fields, bad])).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where("_corrupt is null").drop("_corrupt")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of new in place of those with equal keys. new must have one row per key."""
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def overwrite_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that rows has; Spark's commit makes each job atomic."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def report_lines(findings: DataFrame, form: str) -> DataFrame:
    """(feature_id, body): findings (feature_id, severity, title, file, line) as text, markdown, json or xml."""
    from textquarry.functions.predicates import severity_order
    from textquarry.functions.text import escape_xml

    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    line = {
        "text": F.concat(F.lit("["), "severity", F.lit("] "), "title", F.lit(" ("), place, F.lit(")")),
        "markdown": F.concat(F.lit("- **"), "severity", F.lit("** "), "title", F.lit(" `"), place, F.lit("`")),
        "json": F.to_json(F.struct("severity", "title", "file", "line")),
        "xml": F.concat(F.lit('<finding severity="'), "severity", F.lit('" at="'), escape_xml(place), F.lit('">'), escape_xml(F.col("title")), F.lit("</finding>")),
    }[form]
    # Lines are put together in pieces of about PIECE_LINES, dealt out by ranges, so that only a report's text meets in one row.
    n = max(1, -(-findings.count() // PIECE_LINES))
    rows = findings.select("feature_id", severity_order(F.col("severity")).alias("o"), "title", "file", "line", line.alias("s"))
    placed = rows.repartitionByRange(n, "feature_id", "o", "title", "file", "line").withColumn("piece", F.spark_partition_id())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "title", "file", "line", "s"))), lambda x: x["s"])
    end = "," if form == "json" else "\n"
    text = F.when(F.exists("lines", lambda x: x.isNotNull()), F.array_join("lines", end))
    pieces = placed.groupBy("feature_id", "piece").agg(ordered.alias("lines")).select("feature_id", "piece", text.alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "s"))), lambda x: x["s"]), end)
    return pieces.groupBy("feature_id").agg((F.concat(F.lit("["), joined, F.lit("]")) if form == "json" else joined).alias("body"))
