"""Strings in texts, and relations between chunks, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import automaton as AU
from textquarry.operators import retrieval as RT

CHUNKS = "id long, content string, symbols array<string>, imports array<string>, exports array<string>"


def plain(rows, strict=False):
    """The rule over all pairs of chunks."""
    imports = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and set(a[3]) & ({*b[2]} | {e for e in b[4] if not e.startswith("* from ")})}
    references = set()
    for b in rows:
        for s in b[2]:
            for a in rows:
                if len(s) >= 3 and a[0] != b[0] and a[1] is not None:
                    new = (a[0], b[0]) not in imports
                    call, other = f"{s}(" in a[1], f"{s}." in a[1] or f" {s} " in a[1]
                    if (new and (call or other)) if strict else (new and call or other):
                        references.add((a[0], b[0]))
    return {(*p, "imports") for p in imports} | {(*p, "references") for p in references}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_relations_equal_all_pairs(spark, seed, strict):
    """Symbols end, begin and hold other words; a few letters, so that much of it happens."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("ab_é") for _ in range(rng.randrange(1, 5)))
    rows = [(i, None if i == 7 else "".join(rng.choice([name(), name(), "(", ".", " ", "\n", "("]) for _ in range(25)), [name() for _ in range(rng.randrange(3))], [name() for _ in range(2)], [name(), "* from ./x"]) for i in range(40)]
    got = [tuple(r) for r in RT.relations(spark.createDataFrame(rows, CHUNKS), strict).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, strict)


def test_a_symbol_inside_a_longer_word(spark):
    rows = [(1, "xfoo(1)", [], [], []), (2, "", ["foo"], [], []), (3, "afoo.b", [], ["foo"], []), (4, "bfoo(", [], ["foo"], [])]
    got = {tuple(r) for r in RT.relations(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got == {(3, 2, "imports"), (4, 2, "imports"), (1, 2, "references"), (3, 2, "references")}


def test_blocks_find_what_one_finds(spark):
    rng = random.Random(5)
    texts = [(str(i) if i % 9 else None, "".join(rng.choice("abc é漢") for _ in range(60))) for i in range(50)] + [("null", None), ("empty", "")]
    strings = sorted({"".join(rng.choice("abc é漢") for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    frames = spark.createDataFrame(texts, "k string, body string"), spark.createDataFrame([(s,) for s in [*strings, *strings[:5], None, ""]], "string string")
    want = sorted((str(k), s) for k, t in texts for s in strings if t and s in t)
    for per_block in (7, 1000):
        assert sorted((str(r.k), r.string) for r in AU.occurring(frames[0], "k", "body", frames[1], per_block).collect()) == want
    assert AU.occurring(frames[0], "k", "body", frames[1].limit(0)).count() == 0


def test_long_text_and_groups(spark, monkeypatch):
    monkeypatch.setattr(AU, "GROUP_BYTES", 10)
    texts = spark.createDataFrame([(1, "needle " + "hay" * 100_000 + " pin"), (2, "pi")], "id int, body string")
    got = AU.occurring(texts, "id", "body", spark.createDataFrame([("needle",), ("pin",), ("pi",)], "string string"))
    assert sorted(map(tuple, got.collect())) == [(1, "needle"), (1, "pi"), (1, "pin"), (2, "pi")] and dict(got.dtypes)["id"] == "int"
    assert got.where(F.col("id") == 2).count() == 1


def test_names_that_calls_are_not_resolved_by():
    from textquarry.functions.names import builtin_names

    names = builtin_names()
    assert {"JSON", "Array", "reduce", "sleep", "read", "write", "isNaN", "Println", "hashCode", "unwrap_or_else", "poll"} <= names
    assert not {"casefold", "isalnum", "partition", "aiter", "charCodeAt", "helper"} & names


def test_paths_alike_equal_all_pairs(spark):
    rng = random.Random(8)
    paths = ["/".join(rng.choice(["a", "ab", "b", "src"]) for _ in range(rng.randrange(1, 4))) + rng.choice([".ts", ".py", ""]) for _ in range(60)]
    a, b = paths[:35] + ["x.ts"], paths[25:] + ["", "x.ts"]
    got = RT.paths_alike(spark.createDataFrame([(p,) for p in a], "file string"), spark.createDataFrame([(p,) for p in b], "changed string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(x, y) for x in a for y in b if (x.endswith(y) or y.endswith(x)) and x and y}


def test_chunks_of_changed_lines(spark):
    chunks = spark.createDataFrame([(1, "repo/src/a.ts", 1, 9), (2, "a.ts", 5, 20), (3, "b/src/xa.ts", 1, 50), (4, "c.py", 1, 5)], "id long, file string, start int, end int")
    lines = spark.createDataFrame([(7, "src/a.ts", 8), (7, "src/a.ts", 8), (8, "c.py", 6), (9, "ts", 30)], "query_id long, file string, line int")
    assert sorted(tuple(r) for r in RT.overlapping_chunks(chunks, lines).collect()) == [(7, 1), (7, 2), (9, 3)]


def test_texts_of_a_batch_are_taken_in_slices(spark):
    texts = spark.range(700).select("id", F.concat(F.lit("x name"), F.col("id").cast("string"), F.lit("(")).alias("text")).coalesce(1)
    names = spark.range(0, 700, 2).select(F.concat(F.lit("name"), F.col("id").cast("string"), F.lit("(")).alias("string"))
    assert AU.SLICE_ROWS < 700
    assert sorted(r.id for r in AU.occurring(texts, "id", "text", names).collect()) == list(range(0, 700, 2))


def test_pairs_of_chunks_are_never_stored(spark, monkeypatch):
    """Chunks that want and offer the same are classes; pairs are put out last, by parts of classes, also of ids with several rows."""
    rows = [(i, f" a{i % 3}bc( x", [f"a{(i + 1) % 3}bc"], [f"a{i % 2}bc"], []) for i in range(150)] + [(7, " a0bc a2bc.", ["own"], ["a2bc", None], ["a1bc"]), (8, "own(", [], [], ["own"]), (200, None, ["own"], ["none"], [])]
    merged = {}
    for i, content, symbols, imports, exports in rows:
        _, c, s, m, e = merged.get(i, (i, "", [], [], []))
        merged[i] = (i, c + "\n" + (content or ""), s + symbols, [x for x in m + imports if x], e + exports)
    want, stored, cut = plain(list(merged.values())), [], RT.cut

    def counted(df):
        df = cut(df)
        stored.append(df.count())
        return df

    monkeypatch.setattr(RT, "cut", counted)
    monkeypatch.setattr(RT, "PART_IDS", 20, raising=False)
    out = RT.relations(spark.createDataFrame(rows, CHUNKS))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(got) > 10_000
    assert max(stored) < 4 * len(rows)


def test_pairs_of_two_parts_are_not_held_at_once(spark):
    """Two explodes in one compiled stage keep all rows that come of one input row: the square of a part."""
    import re

    rows = [(i, " abc( x", [], ["abc"], []) for i in range(30)] + [(30, "", ["abc"], [], [])]
    out = RT.relations(spark.createDataFrame(rows, CHUNKS))
    assert len(out.collect()) == 30
    plan = out._jdf.queryExecution().executedPlan().toString()
    stage = {c: set(re.findall(rf"\*\((\d+)\) Generate explode\({c}", plan)) for c in ("srcs", "dsts")}
    assert stage["srcs"] and stage["dsts"] and not stage["srcs"] & stage["dsts"]
