"""Column profiles, histograms, correlations and CQI spread."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, count_if
from ..session import small_side
from .joins import null_safe_join
from .quantiles import grouped_quantiles

PROFILE_QUANTILES = {"q1": 0.01, "q5": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}


def column_profile(df: DataFrame, columns, approx: bool = False) -> DataFrame:
    """Null fraction, count, mean, sample deviation, range and nearest-rank quantiles per numeric column.

    Quantiles are exact by default; ``approx`` uses a sketch instead.
    """
    columns = list(columns)
    # A column travels by its number, which is cheaper to group and join by than its name.
    long = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("column_id", "column_value"))
    if approx:
        wide = long.groupBy("column_id").agg(*[F.percentile_approx("column_value", q, 10_000).alias(n) for n, q in PROFILE_QUANTILES.items()])
    else:
        ranks = grouped_quantiles(long, ["column_id"], "column_value", PROFILE_QUANTILES.values(), "nearest")
        wide = ranks.groupBy("column_id").agg(*[
            F.max(F.when(F.col("q") == q, F.col("column_value"))).alias(n) for n, q in PROFILE_QUANTILES.items()
        ])
    return _column_stats(df, columns).join(F.broadcast(wide), "column_id", "left").drop("column_id")  # a row a column


def _column_stats(df: DataFrame, columns) -> DataFrame:
    """One row per column from one aggregation over the rows as they are."""
    aggs = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        aggs += [count_if(value.isNull()).alias(f"null{i}"), F.avg(value).alias(f"mean{i}"), F.stddev_samp(value).alias(f"std{i}"),
                 F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    cells = F.array(*[
        F.struct(F.lit(i).alias("column_id"), F.lit(c).alias("column_name"), "rows", (F.col(f"null{i}") / F.col("rows")).alias("missing_fraction"),
                 *[F.col(f"{name}{i}").alias(name) for name in ("mean", "std", "min", "max")])
        for i, c in enumerate(columns)
    ])
    return row.where(F.col("rows") > 0).select(F.explode(cells).alias("cell")).select("cell.*")


def rates(df: DataFrame, success_value: int = 1) -> DataFrame:
    """Pass, acknowledgement and violation rate, and mean bytes delivered per row."""
    ok = F.col("blkerr") == success_value
    return df.agg(
        F.avg(F.col("label_pass").cast("double")).alias("pass_rate"),
        F.avg(ok.cast("double")).alias("ack_rate"),
        F.avg((F.col("bler") > F.col("target_bler")).cast("double")).alias("violation_rate"),
        F.avg(F.when(ok, F.col("tbs").cast("double")).otherwise(0.0)).alias("throughput_bytes_per_row_mean"),
    )


def correlations(df: DataFrame, columns) -> DataFrame:
    """Pearson correlation of every column pair (pairwise complete), long form, from one aggregation."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.explode(cells).alias("cell")).select("cell.*")


def _bin_index(value, low, high, bins: int):
    width = (high - low) / F.lit(bins)
    raw = F.when(width == 0, F.lit(0)).otherwise(F.floor((value - low) / F.when(width != 0, width)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("bigint")


def histogram(df: DataFrame, column: str, bins: int, limits=None, edges: str = "data") -> DataFrame:
    """Counts per equal-width bin. ``limits`` clips values first; edges span the (clipped) data or the limits."""
    value = F.col(column).cast("double")
    if limits is not None:
        value = clip(value, float(limits[0]), float(limits[1]))
    clipped = df.where(F.col(column).isNotNull()).select(value.alias("x"))
    if edges == "data":
        span = clipped.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        clipped = clipped.join(F.broadcast(span))
    else:
        clipped = clipped.withColumns({"lo": F.lit(float(limits[0])), "hi": F.lit(float(limits[1]))})
    counted = clipped.withColumn("bin", _bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.min("lo").alias("lo"), F.min("hi").alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_lower"), "count")


def density(df: DataFrame, x: str, y: str, bins: int = 60, y_limits=(0.0, 1.0)) -> DataFrame:
    """Counts on a rectangular grid of ``bins`` x ``bins`` cells, with the log count."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), clip(F.col(y).cast("double"), *map(float, y_limits)).alias("y")
    )
    span = data.agg(*[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    cells = data.join(F.broadcast(span)).select(
        _bin_index(F.col("x"), F.col("xlo"), F.col("xhi"), bins).alias("x_bin"),
        _bin_index(F.col("y"), F.col("ylo"), F.col("yhi"), bins).alias("y_bin"),
    )
    return cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "log_count", F.log10(F.col("count").cast("double"))
    )


def pass_rate_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.col("label_pass").cast("double")).alias("pass_rate"))


def cqi_spread(df: DataFrame, point: str, cqi: str = "cqi", percent: float = 90.0) -> DataFrame:
    """Median CQI, central percentile band and share of reports more than 1 away from the median, per point."""
    low, high = (0.5 - percent / 200, 0.5 + percent / 200)
    # CQI has 16 values at most, so value counts carry everything that follows.
    counts = df.groupBy(point, cqi).agg(F.count(F.lit(1)).alias("_n"))
    q = grouped_quantiles(df, [point], cqi, [low, 0.5, high], "midpoint").groupBy(point).agg(
        F.max(F.when(F.col("q") == 0.5, F.col(cqi))).alias("cqi_median"),
        F.max(F.when(F.col("q") == low, F.col(cqi))).alias("cqi_low"),
        F.max(F.when(F.col("q") == high, F.col(cqi))).alias("cqi_high"),
    )
    far = F.sum(F.when(F.abs(F.col(cqi) - F.col("cqi_median")) > 1, F.col("_n")).otherwise(0))
    return null_safe_join(counts, small_side(q), [point]).groupBy(point, "cqi_median", "cqi_low", "cqi_high").agg(
        (far / F.sum("_n")).alias("far_share")
    )
