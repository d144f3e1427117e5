"""Caps, top-k, repeatable samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_fraction, md5_fraction
from ..session import small_side
from .joins import null_safe_join
from .ordered import running_sums


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_slices(df: DataFrame, column: str, k: int, min_count: int = 1) -> DataFrame:
    """Most frequent values with enough rows; equal counts go to the lower value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    return counts.orderBy(F.col("count").desc(), F.col(column)).limit(k)


def top_values_per_row(df: DataFrame, key: str, columns, k: int = 5) -> DataFrame:
    """Largest k columns by magnitude of each row: ``key, feature, value, rank`` (no shuffle)."""
    entries = F.array(*[
        F.struct((-F.abs(F.col(c))).alias("m"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])
    return df.select(key, F.posexplode(F.slice(F.sort_array(entries), 1, k)).alias("pos", "e")).select(
        key, "e.feature", "e.value", (F.col("pos") + 1).alias("rank")
    )


def sample_rows(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """n rows without replacement, repeatable under any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), *key).limit(n)


def random_split(df: DataFrame, test_fraction: float, key, seed: int = 42, out: str = "split",
                 portable: bool = False) -> DataFrame:
    """``train``/``test`` per row from a hash of its key: one pass, no shuffle.

    ``portable`` hashes the key's texts by MD5, which any other engine can repeat; keys should be whole numbers or
    strings then. A null key column is an empty text.
    """
    share = md5_fraction(key, seed) if portable else hash_fraction(key, seed)
    return df.withColumn(out, F.when(share < test_fraction, "test").otherwise("train"))


def exact_split(df: DataFrame, test_fraction: float, key, strata=(), seed: int = 42, out: str = "split") -> DataFrame:
    """Shuffled split with exact counts, overall or per stratum (at least one test row each).

    Ranks come from chunked running counts, so a large stratum is not sorted in one task.
    """
    strata = list(strata)
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(k) for k in key]))
    ranked = running_sums(hashed, strata, ["_h", *key], {"_rank": F.lit(1)})
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    sized = null_safe_join(ranked, small_side(sizes), strata) if strata else ranked.join(F.broadcast(sizes))
    n_test = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(test_fraction)))
    return sized.withColumn(out, F.when(F.col("_rank") <= n_test, "test").otherwise("train")).drop("_h", "_rank", "_n")


def distinct_values(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns).distinct()
