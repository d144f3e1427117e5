"""Joins in which null keys meet null keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal or both-null ``keys``; the keys come from ``left``."""
    names = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[n]) for k, n in names.items()])
    return left.join(other, on, how).drop(*names.values())
