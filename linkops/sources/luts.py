"""Lookup-table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clip, code


def _lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _codes(df: DataFrame, keys: dict[str, float], order) -> DataFrame:
    """Integer codes per key column; unparsable rows skipped, last duplicate wins."""
    codes = [code(F.col(k).try_cast("double"), w).alias(f"{k}_code") for k, w in keys.items()]
    parsed = df.select(*codes, F.col("mcs").try_cast("double").cast("int").alias("mcs"), *order).dropna(
        subset=[f"{k}_code" for k in keys] + ["mcs"]
    )
    return parsed.groupBy(*[f"{k}_code" for k in keys]).agg(F.max_by("mcs", F.struct(*order)).alias("mcs"))


def _ordered_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = _lower_names(spark.read.option("header", "true").csv(path))
    return raw.select("*", F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_pos"))


def read_snr_lut(spark: SparkSession, path: str, snr_bin: float = 0.1) -> DataFrame:
    """1-D table ``(snr_code, mcs)`` from a CSV with ``snr`` or ``snr_bin`` and ``mcs`` (any case)."""
    raw = _ordered_csv(spark, path)
    snr = next((c for c in ("snr", "snr_bin") if c in raw.columns), None)
    if snr is None or "mcs" not in raw.columns:
        raise ValueError("SNR table needs columns snr (or snr_bin) and mcs")
    return _codes(raw.withColumnRenamed(snr, "snr"), {"snr": snr_bin}, ["_block", "_pos"])


def read_snr_cqi_lut(spark: SparkSession, path: str, snr_bin: float = 0.1, cqi_bin: float = 1.0) -> DataFrame:
    """2-D table ``(snr_code, cqi_code, mcs)`` from a CSV with ``snr, cqi, mcs`` (any case)."""
    raw = _ordered_csv(spark, path)
    missing = {"snr", "cqi", "mcs"} - set(raw.columns)
    if missing:
        raise ValueError(f"table lacks columns {sorted(missing)}")
    return _codes(raw, {"snr": snr_bin, "cqi": cqi_bin}, ["_block", "_pos"])


def lut_from_rows(df: DataFrame, order, snr_bin: float = 0.1, cqi_bin: float | None = 1.0) -> DataFrame:
    """Same contract for a frame that already has ``snr[, cqi], mcs`` and order columns."""
    keys = {"snr": snr_bin}
    if cqi_bin is not None:
        keys["cqi"] = cqi_bin
    return _codes(df, keys, order)


def filter_lut(df: DataFrame, mcs_min: int = 0, mcs_max: int = 15) -> DataFrame:
    """Round CQI and MCS, clamp MCS, order by SNR and CQI."""
    return df.select(
        "snr",
        F.rint("cqi").cast("int").alias("cqi"),
        clip(F.rint("mcs").cast("int"), mcs_min, mcs_max).alias("mcs"),
    ).orderBy("snr", "cqi")


def round_snr(df: DataFrame, digits: int = 1) -> DataFrame:
    """Repair float noise in the SNR key (half-even on ``digits``)."""
    scale = 10.0 ** digits
    return df.withColumn("snr", F.rint(F.col("snr") * scale) / scale)


