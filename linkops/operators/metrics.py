"""Transmission metrics: rates, block-error curves, distributions, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import radio
from ..functions.expr import col, count_if, floor_bin, micros, safe_div
from ..session import small_side
from .joins import null_safe_join
from .ordered import running_sums


def throughput_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "instantaneous_throughput_mbps": radio.throughput_mbps("tbs"),
        "instantaneous_trueput_mbps": radio.trueput_mbps("tbs", "ack_status"),
    })


def relative_time(df: DataFrame, keys=("file",), ts: str = "ts", out: str = "pdsch_time_relative_s") -> DataFrame:
    """Seconds since the first transmission of each source."""
    starts = df.groupBy(*keys).agg(F.min(micros(ts)).alias("_start"))
    return null_safe_join(df, small_side(starts), list(keys)).withColumn(out, (micros(ts) - F.col("_start")) / 1e6).drop("_start")


def running_error_rate(df: DataFrame, series, order, nack: Column, out: str = "bler") -> DataFrame:
    """Cumulative block-error percentage: errors so far over rows so far."""
    run = running_sums(df, series, order, {"_nack": nack.cast("bigint"), "_n": F.lit(1)})
    return run.withColumn(out, F.col("_nack") / F.col("_n") * 100).drop("_nack", "_n")


def cumulative(df: DataFrame, series, order, columns: dict[str, str]) -> DataFrame:
    """Cumulative sums, output name to source column."""
    return running_sums(df, series, order, {out: col(c) for out, c in columns.items()})


# Throughput columns by preference, with the divisor to Mbit/s.
THROUGHPUT_CHOICES = [
    ("throughput_mbps_per_sec", "trueput_mbps_per_sec", 1),
    ("instantaneous_throughput_mbps", "instantaneous_trueput_mbps", 1),
    ("throughput_kbps_per_sec", "trueput_kbps_per_sec", 1000),
    ("instantaneous_throughput_kbps", "instantaneous_trueput_kbps", 1000),
]


def resolve_throughput(df: DataFrame) -> DataFrame:
    """``throughput_mbps`` (and ``trueput_mbps`` if known) from the best column present."""
    for throughput, trueput, divisor in THROUGHPUT_CHOICES:
        if throughput in df.columns:
            out = df.withColumn("throughput_mbps", F.col(throughput) / divisor)
            return out.withColumn("trueput_mbps", F.col(trueput) / divisor) if trueput in df.columns else out
    return df.withColumn("throughput_mbps", radio.legacy_kbps("tbs") / 1000)


def snr_bins(df: DataFrame, snr: str = "dl_sinr", width: float = 1.0, out: str = "snr_bin_center") -> DataFrame:
    """Right-closed bins of ``width`` starting at the floor of the lowest value; that edge belongs to bin one."""
    present = df.where(F.col(snr).isNotNull())
    low = present.agg(F.floor(F.min(snr)).cast("double").alias("_low"))
    step = F.ceil((F.col(snr) - F.col("_low")) / F.lit(width)) - 1
    return (
        present.join(F.broadcast(low))
        .withColumn(out, F.col("_low") + (F.greatest(step, F.lit(0)) + F.lit(0.5)) * F.lit(width)).drop("_low")
    )


def snr_error_curve(df: DataFrame, snr: str = "dl_sinr", width: float = 1.0, keys=(), digits: int = 4,
                    means=("mcs", "tbs", "dl_rsrp", "dl_rsrq", "ul_sinr")) -> DataFrame:
    """Block-error rate and mean context per SNR bin."""
    curve = snr_bins(df, snr, width).groupBy(*keys, "snr_bin_center").agg(
        F.count("ack_status").alias("total_transmissions"),
        count_if(F.col("ack_status") == 0).alias("nack_count"),
        *[F.round(F.avg(m), digits).alias(f"avg_{m}") for m in means if m in df.columns],
    )
    return curve.withColumn("bler_percent", F.col("nack_count") / F.col("total_transmissions") * 100)


def snr_throughput_curve(df: DataFrame, snr: str = "dl_sinr", width: float = 1.0, keys=(), digits: int = 4) -> DataFrame:
    """Mean, sample deviation and count of throughput (and trueput) per SNR bin."""
    resolved = resolve_throughput(df)
    aggs = [
        F.round(F.avg("throughput_mbps"), digits).alias("avg_throughput_mbps"),
        F.round(F.stddev_samp("throughput_mbps"), digits).alias("std_throughput_mbps"),
        F.count("throughput_mbps").alias("sample_count"),
        F.round(F.avg("mcs"), digits).alias("avg_mcs"),
        F.round(F.avg("tbs"), digits).alias("avg_tbs"),
    ]
    if "trueput_mbps" in resolved.columns:
        aggs += [
            F.round(F.avg("trueput_mbps"), digits).alias("avg_trueput_mbps"),
            F.round(F.stddev_samp("trueput_mbps"), digits).alias("std_trueput_mbps"),
        ]
    return snr_bins(resolved, snr, width).groupBy(*keys, "snr_bin_center").agg(*aggs)


def error_by_mcs(df: DataFrame, min_count: int = 5) -> DataFrame:
    """Block-error percentage per MCS over rows with feedback, for indexes seen often enough."""
    return (
        df.where(F.col("ack_status").isNotNull()).groupBy("mcs")
        .agg(F.count(F.lit(1)).alias("count"), F.avg((F.col("ack_status") == 0).cast("double")).alias("_r"))
        .where(F.col("count") >= min_count)
        .select("mcs", "count", F.round(F.col("_r") * 100, 2).alias("bler_pct"))
    )


def distribution(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Counts and percentages of each value. With ``weight`` a row stands for so many equal ones."""
    counts = df.groupBy(column).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count"))
    total = F.broadcast(counts.agg(F.sum("count").alias("_all")))  # one row
    return counts.join(total).withColumn("percent", F.col("count") / F.col("_all") * 100).drop("_all")


def harq_process_stats(df: DataFrame, keys=("ue_id", "rnti", "harq_id")) -> DataFrame:
    """Attempts, acknowledgements and efficiency per process key."""
    return df.groupBy(F.concat_ws("_", *[F.col(k).cast("string") for k in keys]).alias("harq_process_key")).agg(
        F.count(F.lit(1)).alias("attempts"), count_if(F.col("ack_status") == 1).alias("acks")
    ).withColumn("efficiency", F.col("acks") / F.col("attempts"))


def harq_totals(df: DataFrame) -> DataFrame:
    """Totals over all processes and the ratio of delivered to sent data."""
    rates = throughput_columns(df)
    return rates.agg(
        F.count(F.lit(1)).alias("total_attempts"),
        count_if(F.col("ack_status") == 1).alias("successful_deliveries"),
        F.sum("tbs").alias("_sent"),
        F.sum(F.when(F.col("ack_status") == 1, F.col("tbs")).otherwise(F.lit(0))).alias("_ok"),
    ).select(
        "total_attempts", "successful_deliveries", safe_div(F.col("_ok"), F.col("_sent")).alias("harq_efficiency")
    )


def per_second(df: DataFrame, keys=("file",), relative: str = "pdsch_time_relative_s") -> DataFrame:
    """Throughput and trueput summed over whole seconds since the start."""
    return df.groupBy(*keys, F.floor(relative).cast("bigint").alias("window_start_time")).agg(
        F.sum("instantaneous_throughput_mbps").alias("throughput_mbps_per_sec"),
        F.sum("instantaneous_trueput_mbps").alias("trueput_mbps_per_sec"),
    )


def run_statistics(df: DataFrame, measured=("dl_rsrp", "dl_rsrq", "dl_sinr", "ul_sinr"), keys=()) -> DataFrame:
    """Totals, ranges, feedback count, block-error percentage and measurement availability in one pass."""
    n = F.count(F.lit(1))
    feedback = F.count("ack_status")
    aggs = [
        n.alias("total_transmissions"),
        F.min("mcs").alias("mcs_min"), F.max("mcs").alias("mcs_max"),
        F.min("tbs").alias("tbs_min"), F.max("tbs").alias("tbs_max"),
        feedback.alias("feedback_count"),
        F.coalesce(F.try_divide(count_if(F.col("ack_status") == 0) * 100.0, feedback), F.lit(0.0)).alias("bler_percent"),
        *[(F.count(m) * 100.0 / n).alias(f"{m}_percent") for m in measured if m in df.columns],
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def mcs_sinr_summary(pairs: DataFrame) -> DataFrame:
    """Ranges, most common MCS (ties: lowest), mean and population deviation of SINR."""
    counts = pairs.groupBy("mcs").agg(F.count(F.lit(1)).alias("_n"))
    common = counts.agg(F.max_by("mcs", F.struct(F.col("_n"), -F.col("mcs"))).alias("most_common_mcs"))
    summary = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.min("mcs").alias("mcs_min"), F.max("mcs").alias("mcs_max"),
        F.min("sinr_db").alias("sinr_min"), F.max("sinr_db").alias("sinr_max"),
        F.avg("sinr_db").alias("sinr_mean"), F.stddev_pop("sinr_db").alias("sinr_std"),
    )
    return summary.join(F.broadcast(common))


def linear_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def binned_means(df: DataFrame, column: str, width: float, means: dict[str, Column], out: str, keys=()) -> DataFrame:
    """Means per floor bin of a column, several series at once."""
    return df.groupBy(*keys, floor_bin(column, width).alias(out)).agg(*[F.avg(c).alias(n) for n, c in means.items()])


def rounded_means(df: DataFrame, snr: str, means: dict[str, str], digits: int = 1, out: str = "snr", keys=()) -> DataFrame:
    """Means per SNR rounded half-even to ``digits``; groups by integer code, not by float."""
    scale = 10.0 ** digits
    grouped = df.groupBy(*keys, F.rint(F.col(snr) * scale).cast("bigint").alias("_code")).agg(
        *[F.avg(c).alias(n) for n, c in means.items()]
    )
    return grouped.select(*keys, (F.col("_code") / scale).alias(out), *means)


def best_mcs_per_snr(df: DataFrame, means, firsts, order, success_value: int = 1, snr: str = "snr") -> DataFrame:
    """Highest successful MCS per SNR (1 digit) with mean context; ``firsts`` come from the earliest row."""
    ok = df.where(F.col("blkerr") == success_value)
    grouped = ok.groupBy(F.rint(F.col(snr) * 10).cast("bigint").alias("_code")).agg(
        F.max("mcs").alias("optimal_mcs"),
        *[F.avg(c).alias(c) for c in means],
        *[F.min_by(c, F.struct(*order)).alias(c) for c in firsts],
    )
    return grouped.select((F.col("_code") / 10.0).alias("snr_rounded"), "optimal_mcs", *means, *firsts)


def time_bin_pivot(df: DataFrame, time: str, label: str, values, bins: int = 50) -> DataFrame:
    """Counts per equal-width time bin and label, missing combinations 0."""
    edges = df.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    step = F.ceil((F.col(time) - F.col("_lo")) / width) - 1
    index = F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("bigint")
    return (
        df.join(F.broadcast(edges)).withColumn("time_bin", index)
        .groupBy("time_bin").pivot(label, list(values)).count().na.fill(0)
    )


def label_pivot(df: DataFrame, row: str, column: str, values=None) -> DataFrame:
    """Row counts as a matrix, missing cells 0. One column for each label of the data, or for each of ``values``, which
    leaves out all others. A table with more labels than ``spark.sql.pivotMaxValues`` is an error."""
    pivot = df.groupBy(row).pivot(column) if values is None else df.groupBy(row).pivot(column, list(values))
    return pivot.count().na.fill(0)


def lut_pivot(lut: DataFrame, row: str, column: str, values=None, value: str = "mcs") -> DataFrame:
    """Mean MCS with one column per key of the second axis, or per listed key."""
    pivot = lut.groupBy(row).pivot(column) if values is None else lut.groupBy(row).pivot(column, list(values))
    return pivot.agg(F.avg(value))


def confusion(df: DataFrame, truth: str, predicted: str, classes=None) -> DataFrame:
    """Counts per true and predicted class; ``classes`` adds the zero cells."""
    counts = df.groupBy(F.col(truth).alias("true_class"), F.col(predicted).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("count")
    )
    if classes is None:
        return counts
    axis = F.array(*[F.lit(c) for c in classes])
    grid = df.sparkSession.range(1).select(F.explode(axis).alias("true_class"))
    grid = grid.select("true_class", F.explode(axis).alias("pred_class"))
    return grid.join(counts, ["true_class", "pred_class"], "left").na.fill(0, ["count"])


def modal_value(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value (ties: lowest)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max_by(column, F.struct(F.col("_n"), -F.col(column))).alias(column))


def distinct_set(df: DataFrame, column: str, out: str = "values") -> DataFrame:
    """The sorted distinct values of a category column as one text; for columns of few values, such as modulations."""
    values = F.array_sort(F.collect_set(F.col(column).cast("string")))
    return df.agg(F.array_join(values, ",").alias(out), F.count_distinct(column).alias("count"))


def difference_summary(pairs: DataFrame) -> DataFrame:
    """Range of each side and mean, max and min of the difference of zipped tables."""
    return pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("left_value").alias("left_min"), F.max("left_value").alias("left_max"),
        F.min("right_value").alias("right_min"), F.max("right_value").alias("right_max"),
        F.avg("difference").alias("mean_difference"), F.max("difference").alias("max_difference"),
        F.min("difference").alias("min_difference"),
    )
