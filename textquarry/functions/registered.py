"""Functions for SQL text: `register(spark)` makes them known to a session.

`identifier_variations(name)` and `symbol_boost(query, symbols)` are SQL functions, which the optimizer sees through; `code_likeness`
takes two located chunks in Arrow batches; `code_chunks(code, language)` is a table function: a row per chunk. Another
`Chunker` can stand in for the one that comes along.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Chunker(Protocol):
    def chunks(self, code: str, language: str | None) -> list[dict]:
        """Of a file: location, code, start_line, end_line, chunk_type and symbol_names of each chunk."""


class SourceChunker:
    """Definitions with their comments, as `operators.chunking` finds them."""

    def chunks(self, code: str, language: str | None) -> list[dict]:
        from textquarry.operators.chunking import chunk_source

        return chunk_source(code, language)


def _variations(name: str) -> str:
    camel, snake = rf"split(lower(regexp_replace({name}, '([a-z])([A-Z])', '$1 $2')), '\\s+')", f"split(lower({name}), '_')"
    joined = lambda parts, by: f"CASE WHEN size({parts}) > 1 THEN concat({parts}, array(array_join({parts}, '{by}'))) ELSE array() END"
    return f"filter(array_distinct(concat(array(lower({name})), {joined(camel, '_')}, {joined(snake, '')})), v -> v <> '')"


def code_chunks_function(chunker: Chunker):
    @F.udtf(returnType="location string, code string, start_line int, end_line int, chunk_type string, symbol_names array<string>")
    class CodeChunks:
        def eval(self, code: str, language: str) -> Iterator[tuple]:
            for c in chunker.chunks(code, language) if code else ():
                yield c["location"], c["code"], c["start_line"], c["end_line"], c["chunk_type"], c["symbol_names"]

    return CodeChunks


def code_likeness(code_a: pd.Series, file_a: pd.Series, start_a: pd.Series, end_a: pd.Series, code_b: pd.Series, file_b: pd.Series, start_b: pd.Series, end_b: pd.Series) -> pd.Series:
    """Words, path and lines in common of two chunks, 0 to 1."""
    from textquarry.operators.similarity import _likeness, _tokens

    rows = zip(code_a, file_a, start_a, end_a, code_b, file_b, start_b, end_b)
    return pd.Series([_likeness((fa, sa, ea, _tokens(a or "")), (fb, sb, eb, _tokens(b or ""))) for a, fa, sa, ea, b, fb, sb, eb in rows], dtype="float64")


def register(spark: SparkSession, chunker: Chunker | None = None) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION identifier_variations(name STRING) RETURNS ARRAY<STRING> RETURN {_variations('name')}")
    each = f"CASE WHEN lower(trim(query)) = lower(s) THEN 3.0D WHEN arrays_overlap({_variations('query')}, {_variations('s')}) THEN 3.0D * 0.7D END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION symbol_boost(query STRING, symbols ARRAY<STRING>) RETURNS DOUBLE RETURN coalesce(get(filter(transform(symbols, s -> {each}), x -> x IS NOT NULL), 0), 1.0D)")
    spark.udf.register("code_likeness", F.pandas_udf(code_likeness, "double"))
    spark.udtf.register("code_chunks", code_chunks_function(chunker or SourceChunker()))
