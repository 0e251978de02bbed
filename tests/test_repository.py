"""Data sources over a real repository."""

import subprocess

import pytest

from textquarry.sources import patterns as P
from textquarry.sources import repository as R


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    R.register(spark)
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Some One", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    texts = {"src/a.ts": "let a = 1\n" * 30, "src/b.py": "import os\n", "lib/deep/c.go": "package c\n", "node_modules/x/i.js": "no", "dist/o.js": "no", "app.min.js": "no", "Dockerfile": "FROM x\n", ".github/workflows/ci.yml": "on: push\n", "notes.txt": "no", "big.md": "x" * 5000, "umlaut ä.md": "é\n"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "first commit")
    (root / "src/b.py").write_text("import sys\n")
    (root / "src/new.rs").write_text("fn main() {}\n")
    git("mv", "src/a.ts", "src/moved.ts")
    git("rm", "-q", "lib/deep/c.go")
    git("add", "-A")
    git("commit", "-qm", "second: moves, adds | and removes")
    return str(root)


def test_tree(spark, repo):
    tree = spark.read.format("source_tree").option("most_bytes", 4000).load(repo)
    got = {r.file: (r.content, r.language, r.size) for r in tree.collect()}
    assert set(got) == {"src/b.py", "src/moved.ts", "src/new.rs", "Dockerfile", ".github/workflows/ci.yml", "umlaut ä.md"}
    assert got["src/b.py"] == ("import sys\n", "python", 11) and got["umlaut ä.md"][0] == "é\n" and got["Dockerfile"][1] is None
    assert "big.md" in {r.file for r in spark.read.format("source_tree").load(repo).select("file").collect()}


def test_partitions_and_filters_are_planned(spark, repo):
    tree = spark.read.format("source_tree").option("partition_bytes", 200).load(repo)
    assert tree.rdd.getNumPartitions() >= 3
    one = tree.where("language = 'python' and file like 'src/%' and size > 5")
    assert [r.file for r in one.collect()] == ["src/b.py"]
    reader = R._Tree({"path": repo})
    left = list(reader.pushFilters([R.EqualTo(("language",), "python"), R.StringStartsWith(("file",), "src/"), R.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)] and [f for p in reader.partitions() for f, *_ in p.files] == ["src/b.py"]
    both = R._Tree({"path": repo, "included": "**/*.py,**/*.rs", "excluded": "**/b.*"})
    list(both.pushFilters([R.In(("file",), ("src/new.rs", "src/b.py")), R.EqualTo(("file",), "src/new.rs")]))
    assert [f for p in both.partitions() for f, *_ in p.files] == ["src/new.rs"]
    apart = R._Tree({"path": repo})
    assert len(list(apart.pushFilters([R.StringStartsWith(("file",), "src/"), R.StringStartsWith(("file",), "lib/")]))) == 1


def test_changes(spark, repo):
    rows = spark.read.format("git_changes").load(repo).orderBy("seq").collect()
    assert {(r.change, r.path) for r in rows} == {("D", "lib/deep/c.go"), ("M", "src/b.py"), ("D", "src/a.ts"), ("A", "src/moved.ts"), ("A", "src/new.rs")}
    given = spark.read.format("git_changes").option("changes", "A:x.ts, D:y/z.py,plain.go").load(repo)
    assert [(r.change, r.path) for r in given.orderBy("seq").collect()] == [("A", "x.ts"), ("D", "y/z.py"), ("M", "plain.go")]
    assert spark.read.format("git_changes").option("base", "HEAD").load(repo).count() == 0
    with pytest.raises(Exception, match="git"):
        spark.read.format("git_changes").option("base", "nowhere").load(repo).collect()


def test_log(spark, repo):
    rows = spark.read.format("git_log").option("partition_rows", 1).load(repo)
    assert rows.rdd.getNumPartitions() == 2
    assert [(r.author, r.subject, r.files) for r in rows.orderBy("files").collect()] == [("Some One", "second: moves, adds | and removes", 4), ("Some One", "first commit", 11)]
    assert [r.subject for r in spark.read.format("git_log").option("range", "HEAD~1..HEAD").load(repo).collect()] == ["second: moves, adds | and removes"]
    assert [r.subject for r in spark.read.format("git_log").option("file", "Dockerfile").load(repo).collect()] == ["first commit"]


def test_pattern_lists():
    assert (len(P.INCLUDED), len(P.EXCLUDED)) == (len(set(P.INCLUDED)), len(set(P.EXCLUDED))) and len(P.EXCLUDED) == 41 and P.MOST_BYTES == 10_000_000
