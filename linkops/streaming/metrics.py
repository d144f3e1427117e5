"""Streaming forms of the column operators and of the windowed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio
from ..operators import features


def log_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of log files as they arrive."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def live_sinr(lines: DataFrame) -> DataFrame:
    """Downlink SINR of every report value on the stream, converted to dB."""
    raw = F.regexp_extract("value", r'"sinr":\s*(\d+)', 1)
    return lines.where(F.col("value").contains('"sinr":')).select(radio.sinr_db(raw.try_cast("int")).alias("dl_sinr")).where(
        F.col("dl_sinr").isNotNull()
    )


def per_second(df: DataFrame, ts: str = "ts", delay: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Throughput and trueput per tumbling window; windows close when the watermark passes them."""
    rates = df.withColumns({"_t": radio.throughput_mbps("tbs"), "_g": radio.trueput_mbps("tbs", "ack_status")})
    return (
        rates.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
        .agg(F.sum("_t").alias("throughput_mbps"), F.sum("_g").alias("trueput_mbps"), F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("window_start"), "throughput_mbps", "trueput_mbps", "rows")
    )


def running_error_rate(df: DataFrame, keys) -> DataFrame:
    """Block-error percentage so far per key (update or complete output)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("ack_status") == 0).cast("double") * 100).alias("bler")
    )


def violation_rate(df: DataFrame, ts: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Share of failed rows per window."""
    return (
        df.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
        .agg(F.avg(1 - F.col("label_pass").cast("double")).alias("violation"), F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("window_start"), "violation", "rows")
    )


def featurize(df: DataFrame, **options) -> DataFrame:
    """Feature rows of a slot stream: the same column operators as in batch."""
    return features.align_schema(features.engineer(df, **options))
