"""Set operations on whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of `a` that aren't in `b`."""
    return a.subtract(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
