"""Data-quality checks, each one an aggregate, and joins whose cardinality is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: NULLs by column; columns that are absent are left out."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns if c in rows.columns])


def outside_range(rows: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """One row: values below low or above high; NULL passes."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return rows.agg(F.count_if(bad).alias("outside"))


def assert_unique(rows: DataFrame, keys: list[str]) -> None:
    if sample := duplicates(rows, keys).limit(5).collect():
        raise ValueError(f"keys {keys} are not unique: {[tuple(r[k] for k in keys) for r in sample]}")


def assert_not_null(rows: DataFrame, columns: list[str]) -> None:
    there = [c for c in columns if c in rows.columns]
    if there:
        found = null_counts(rows, there).first().asDict()
        if bad := {c: n for c, n in found.items() if n}:
            raise ValueError(f"NULLs where none may be: {bad}")


def join_many_to_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that never multiplies rows: the right side's keys are checked first."""
    assert_unique(one, keys)
    return many.join(one, keys, how)
