"""Checks of tables: header, types, duplicate keys, domains, completeness of a grid, equality of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def header_ok(df: DataFrame, columns: list[str]) -> bool:
    return df.columns == columns


def not_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which a filled column is no number."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull())
    return df.where(bad)


def duplicates(df: DataFrame, *key: str, count: str = "n") -> DataFrame:
    rows = df.groupBy(*key).agg(F.count("*").alias(count))
    return rows.where(rows[count] > 1)


def outside(df: DataFrame, column: str, domain: list) -> DataFrame:
    return df.where(~F.col(column).isin(domain) | F.col(column).isNull())


def missing(df: DataFrame, *sides: DataFrame) -> DataFrame:
    """Rows of the grid of the sides (tables of distinct values, one column or more each) that df lacks. The grid itself is the question
    asked; its sides are joined in Spark, the first as it is dealt and the others as the planner finds them small or not."""
    grid = sides[0]
    for s in sides[1:]:
        grid = grid.crossJoin(s)
    return grid.join(df.select(*grid.columns).distinct(), grid.columns, "left_anti")


def same_bytes(a: DataFrame, b: DataFrame) -> bool:
    """Whether two binaryFile tables hold the same contents."""
    digest = lambda df: df.select(F.sha2("content", 256).alias("d"))
    return digest(a).exceptAll(digest(b)).isEmpty() and digest(b).exceptAll(digest(a)).isEmpty()
