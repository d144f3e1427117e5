"""Named queries over the driver tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("logs", "features", "metrics", "luts", "policies", "evaluation", "models", "streams")


def query(key: str, sql: str | None = None, rounded: str = "", digits: int = DIGITS):
    """Register ``fn(spark, sf_dir)``; the listed double columns are rounded in Spark and in the SQL twin."""
    names = rounded.split()

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({n: F.round(F.col(n), digits) for n in names}) if names else df

        if key in _QUERIES:
            raise ValueError(f"duplicate key {key}")
        _QUERIES[key] = run
        if sql is not None:
            if names:
                replaced = ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
                _ORACLES[key] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS q"
            else:
                _ORACLES[key] = sql
        return fn

    return register


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__package__}.{name}")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
