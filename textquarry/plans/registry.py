"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """tables(name) reads a table; tables.path(name) is where it lies."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(sql: str | None = None):
    """Register a function (spark, tables) as a query; tables(name) reads a table."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(spark, Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def sql_list(values) -> str:
    """A DuckDB list of these strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: Column) -> Column:
    """values[index % n] as a column."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"{sql_list(values)}[({index}) % {len(values)} + 1]"


def number(c, digits: int = 6) -> Column:
    return F.round(c, digits)


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def sql_value(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def expected(key: str, table: str, index: str, columns: tuple[str, ...], rows: tuple[tuple, ...]) -> str:
    """SQL for rows of a table that cycle through cases whose results are stated: row i has those of case i modulo their number."""
    return expected_rows(key, table, index, columns, tuple((r,) for r in rows))


def expected_rows(key: str, table: str, index: str, columns: tuple[str, ...], cases: tuple[tuple[tuple, ...], ...]) -> str:
    """The same where a case has any number of rows."""
    values = ", ".join(f"({i}, {', '.join(map(sql_value, r))})" for i, rows in enumerate(cases) for r in rows)
    return f"select {key}, {', '.join(f'x.{c}' for c in columns)} from {table} join (values {values}) x(_case, {', '.join(columns)}) on {index} % {len(cases)} = _case"
