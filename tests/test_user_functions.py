"""Functions in SQL text, and embeddings against a plain decomposition."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textquarry.functions import registered as R
from textquarry.functions.text import identifier_variations
from textquarry.operators import embedding as E
from textquarry.operators import search as S

NAMES = ["getUserName", "get_user_name", "parseHTTPResponse", "simple", "_a__b", "", "Two words", None]


def test_scalar_functions_in_sql_text(spark):
    R.register(spark)
    rows = spark.createDataFrame([(n, ["getUserName", "other_name", "x"]) for n in NAMES], "name string, symbols array<string>")
    rows.createOrReplaceTempView("named")
    got = spark.sql("select name, identifier_variations(name) as v, symbol_boost(name, symbols) as b from named").collect()
    want = rows.select("name", identifier_variations(F.col("name")).alias("v"), S.symbol_boost(F.col("name"), F.col("symbols")).alias("b")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.b for r in got} == {1.0, 3.0, 3.0 * 0.7}


def test_table_function_and_likeness_in_sql_text(spark):
    R.register(spark)
    spark.createDataFrame([(1, "import os\n\ndef run(a):\n    return a\n", "python"), (2, None, None), (3, "function f() {\n  g()\n}\n", "javascript")], "id int, code string, language string").createOrReplaceTempView("files")
    got = spark.sql("select id, c.chunk_type, c.start_line, c.symbol_names from files, lateral code_chunks(code, language) c").collect()
    want = [(i, c["chunk_type"], c["start_line"], c["symbol_names"]) for i, code, lang in ((1, "import os\n\ndef run(a):\n    return a\n", "python"), (3, "function f() {\n  g()\n}\n", "javascript")) for c in R.SourceChunker().chunks(code, lang)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(got) >= 3
    same = spark.sql("select code_likeness('one two three', 'a/b.ts', 1, 5, 'one two four', 'a/b.ts', 3, 9) as x, code_likeness('one', 'a.ts', 1, 1, 'zzz', 'q/b.ts', 1, 1) as y").first()
    assert abs(same.x - (0.4 * 0.5 + 0.4 + 0.2 * 3 / 7)) < 1e-9 and same.y == 0


def test_another_chunker(spark):
    class Lines:  # in here, as workers do not have this module
        def chunks(self, code, language):
            return [{"location": f"{i}-{i}", "code": x, "start_line": i, "end_line": i, "chunk_type": "line", "symbol_names": []} for i, x in enumerate(code.split("\n"), 1)]

    R.register(spark, Lines())
    assert [r.code for r in spark.sql("select * from code_chunks('a\nb', 'x') order by start_line").collect()] == ["a", "b"]


def test_a_model_of_ones_own(spark):
    class Lengths:
        """An embedder for the test: length and number of vowels."""

        def embed(self, texts):
            return np.array([[len(t), sum(c in "aeiou" for c in t)] for t in texts], dtype=float).reshape(-1, 2)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", None, "", "eel" * 50])], "id int, text string")
    got = {r.id: r.embedding for r in E.model_embeddings(docs, "text", Lengths, stored=6).collect()}
    assert got == {0: [3, 1, 0, 0, 0, 0], 1: [0] * 6, 2: [0] * 6, 3: [150, 100, 0, 0, 0, 0]}


def test_directions_equal_a_plain_decomposition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").select("doc_id", "text").union(spark.createDataFrame([(10**6, None)], "doc_id long, text string"))
    size, features = 12, 64
    model = E.SvdEmbedder.fit(docs, "text", size, features, rounds=200)
    rows = E.weighted_terms(docs, "text", features).select("doc_id", "_h").toPandas().sort_values("doc_id")
    x = E._matrix(pd.Series(rows["_h"]), features)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    plain = x @ v[:size].T
    plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-12)
    got = model.embed(docs, "text", stored=20).toPandas().sort_values("doc_id")
    made = np.array(got["embedding"].tolist())
    assert made.shape[1] == 20 and not made[:, size:].any() and not made[-1].any()
    assert np.abs(made[:, :size] @ made[:, :size].T - plain @ plain.T).max() < 1e-3
    for i in range(0, len(x), 17):  # the same neighbours
        assert np.argsort(-made @ made[i])[1] == np.argsort(-plain @ plain[i])[1] or abs(np.sort(plain @ plain[i])[-2] - np.sort(plain @ plain[i])[-3]) < 1e-3
