"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

__all__ = ["ascii_lower", "batch_rows", "fresh", "materialize", "render", "scratch_path", "small_batches", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def render(text: str, **values) -> str:
    """Fill ``{name}`` marks of an SQL text that also holds other braces."""
    for name, value in values.items():
        text = text.replace("{" + name + "}", str(value))
    return text


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same on texts of single-byte characters, and is much faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever its case rules."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Send long texts to Python in batches of at most ``rows`` rows, so that a worker holds few of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Actions inside the block send at most ``rows`` rows at once to Python; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)
