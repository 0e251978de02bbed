"""Repositories as data sources: `spark.read.format("source_tree")`, `"git_changes"` and `"git_log"`, after `register(spark)`.

All plan their partitions before anything is read. `source_tree` lists folders that no pattern leaves out, deals the files to partitions of
about `partition_bytes`, and takes filters on `file` and `language` into the listing, so files that they leave out are never opened.
`git_changes` deals the changed paths, and `git_log` ranges of commits. Trees are read through Arrow's file systems (a path, or
a URI such as hdfs:// or s3://); the git sources need the repository at a path that every executor has.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from textquarry.functions.predicates import LANGUAGES
from textquarry.sources.patterns import EXCLUDED, INCLUDED, MOST_BYTES

TREE = "file string, content string, language string, size long, modified timestamp"
CHANGES = "seq int, change string, path string"
LOG = "sha string, author string, date timestamp, subject string, files int"


def language(path: str) -> str | None:
    dot = path.rfind(".", path.rfind("/") + 1)
    return LANGUAGES.get(path[dot:].lower()) if dot >= 0 else None


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int, float]]


class _Tree(DataSourceReader):
    def __init__(self, options: dict):
        from textquarry.sources.files import glob_to_regex

        self.root = options["path"]
        lists = lambda name, default: options[name].split(",") if options.get(name) else default
        any_of = lambda globs: re.compile("|".join(map(glob_to_regex, globs)))
        self.included, self.excluded = any_of(lists("included", INCLUDED)), any_of(lists("excluded", EXCLUDED))
        self.most, self.per = int(options.get("most_bytes", MOST_BYTES)), int(options.get("partition_bytes", 32 << 20))
        self.files: set[str] | None = None
        self.languages: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership on file and language, and beginnings of file; the others stay with the engine."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("file",):
                self.files = values if self.files is None else self.files & values
            elif values is not None and f.attribute == ("language",):
                self.languages = values if self.languages is None else self.languages & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("file",) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                self.prefix = max(self.prefix, f.value, key=len)
            else:
                yield f

    def _open(self):
        from pyarrow import fs

        if "://" in self.root:
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), "/" + self.root.removeprefix("file:").lstrip("/")

    def _listed(self) -> Iterator[tuple[str, int, float]]:
        from pyarrow import fs

        files, top = self._open()
        waiting = [top.rstrip("/")]
        while waiting:
            for info in files.get_file_info(fs.FileSelector(waiting.pop())):
                path = info.path[len(top.rstrip("/")) + 1 :]
                if info.type == fs.FileType.Directory:
                    ahead = path + "/"
                    if not self.excluded.match(ahead + "x") and (ahead.startswith(self.prefix) or self.prefix.startswith(ahead)):
                        waiting.append(info.path)
                elif info.size <= self.most and self.included.match(path) and not self.excluded.match(path) and path.startswith(self.prefix):
                    if (self.files is None or path in self.files) and (self.languages is None or language(path) in self.languages):
                        yield path, info.size, info.mtime.timestamp() if info.mtime else 0.0

    def partitions(self) -> list[InputPartition]:
        out, held = [Files([])], 0
        for file in sorted(self._listed()):
            if held and held + file[1] > self.per:
                out.append(Files([]))
                held = 0
            out[-1].files.append(file)
            held += file[1]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        from datetime import UTC, datetime

        files, top = self._open()
        for path, size, mtime in partition.files:
            with files.open_input_file(f"{top.rstrip('/')}/{path}") as f:
                content = f.read().decode("utf-8", "replace")
            yield path, content, language(path), size, datetime.fromtimestamp(mtime, UTC)


class SourceTree(DataSource):
    """Options: path; included and excluded (globs, by commas); most_bytes; partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _Tree(dict(self.options))


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


@dataclass
class Part(InputPartition):
    rows: list[tuple]


class _Changes(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.base, self.head, self.listed, self.per = options["path"], options.get("base"), options.get("head", "HEAD"), options.get("changes"), int(options.get("partition_rows", 10_000))

    def _rows(self) -> Iterator[tuple[str, str]]:
        """(A, M or D, path); a rename is a deletion and an addition, other codes are dropped. A given list comes first."""
        if self.listed:
            for item in filter(None, map(str.strip, self.listed.split(","))):
                code, colon, path = item.partition(":")
                yield (code, path) if colon and code in "AMD" else ("M", item)
            return
        base = self.base or _git(self.repo, "rev-parse", f"{self.head}~1").strip()
        fields = iter(_git(self.repo, "diff", "--name-status", "-z", base, self.head).split("\0"))
        for code in fields:
            if not code:
                return
            path = next(fields)
            if code[0] in "RC":
                new = next(fields)
                if code[0] == "R":
                    yield "D", path
                    yield "A", new
            elif code[0] in "AMD":
                yield code[0], path

    def partitions(self) -> list[InputPartition]:
        rows = [(i, *r) for i, r in enumerate(self._rows())]
        return [Part(rows[i : i + self.per]) for i in range(0, max(1, len(rows)), self.per)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.rows


class GitChanges(DataSource):
    """Options: path; base (the commit before head) and head (HEAD), or changes ("A:path,M:path,…"); partition_rows."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> DataSourceReader:
        return _Changes(dict(self.options))


class _Log(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.range, self.file, self.per = options["path"], options.get("range", "HEAD"), options.get("file"), int(options.get("partition_rows", 5000))

    def partitions(self) -> list[InputPartition]:
        """Ranges of commits; the sources of a shallow or huge history are counted by git, not listed."""
        n = int(_git(self.repo, "rev-list", "--count", self.range, *self._paths()))
        return [Part([(i, min(self.per, n - i))]) for i in range(0, n, self.per)] or [Part([])]

    def _paths(self) -> tuple[str, ...]:
        return ("--", self.file) if self.file else ()

    def read(self, partition: Part) -> Iterator[tuple]:
        from datetime import UTC, datetime

        for skip, count in partition.rows:
            text = _git(self.repo, "log", f"--skip={skip}", f"--max-count={count}", "--format=%x1e%H%x1f%an%x1f%at%x1f%s%x1f", "--name-only", self.range, *self._paths())
            for record in text.split("\x1e")[1:]:
                sha, author, at, subject, rest = record.split("\x1f", 4)
                yield sha, author, datetime.fromtimestamp(int(at), UTC), subject, len([p for p in rest.split("\n") if p])


class GitLog(DataSource):
    """Options: path; range (HEAD, or "base..head"); file (only commits that touch it); partition_rows."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return _Log(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats known to the session and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SourceTree, GitChanges, GitLog):
        spark.dataSource.register(source)
