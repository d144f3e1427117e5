"""Writers: split Parquet tables, small sorted CSV tables, report files, saved transmissions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSMISSION_SCHEMA = (
    "pdsch_timestamp timestamp, harq_timestamp timestamp, time_diff_ms double, ue_id int, rnti string, "
    "harq_id int, mcs int, tbs bigint, nrtx int, transmission_type string, ack_status double, ack_result string, "
    "dl_rsrp double, dl_rsrq double, dl_sinr double, ul_sinr double, pdsch_time_relative_s double, bler double"
)


def write_split_parquet(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    """Train and test rows in one pass, as partitions of one Snappy table; reading the root is the union."""
    df.write.mode(mode).option("compression", "snappy").partitionBy(split).parquet(path)


def write_small_csv(df: DataFrame, path: str, order, mode: str = "error") -> None:
    """One sorted CSV with header. For report and lookup tables only; large frames stay in Parquet."""
    df.orderBy(*order).coalesce(1).write.mode(mode).option("header", "true").csv(path)


def write_transmissions(df: DataFrame, path: str, mode: str = "error") -> None:
    """All transmissions as CSV, one file per partition, columns of the saved-transmission contract."""
    names = [part.split()[0] for part in TRANSMISSION_SCHEMA.split(", ")]
    df.select(*names).write.mode(mode).option("header", "true").csv(path)


def read_transmissions(spark: SparkSession, path: str) -> DataFrame:
    """Re-enter the statistics from saved transmissions without parsing logs again."""
    return spark.read.option("header", "true").schema(TRANSMISSION_SCHEMA).csv(path)


def write_predictions(scored: DataFrame, path: str, features, mode: str = "error") -> None:
    """Prediction export: probability, label and block size first, then the features."""
    wanted = ["pred_prob", "label_pass", "tbs", *features]
    scored.select(*[c for c in wanted if c in scored.columns]).write.mode(mode).parquet(path)


def report_row(metrics: DataFrame, at_tau: DataFrame | None = None, worst: DataFrame | None = None) -> DataFrame:
    """One row with the sections ``predictive``, ``at_threshold`` and ``worst_slice_at_threshold``.

    Every input is a one-row aggregate.
    """
    report = metrics.select(F.struct(*metrics.columns).alias("predictive"))
    for name, part in (("at_threshold", at_tau), ("worst_slice_at_threshold", worst)):
        if part is not None:
            section = part.select(F.struct(*part.columns).alias(name)).limit(1)
            report = report.join(F.broadcast(section), F.lit(True), "left")
    return report


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """Report as one JSON document in folder ``path``, and its text summary in ``path``-summary."""
    report.coalesce(1).write.mode(mode).json(path)
    lines = report.select(F.explode(F.array(*[
        F.concat(F.lit(f"{name}: "), F.to_json(name)) for name in report.columns
    ])).alias("value"))
    lines.where(F.col("value").isNotNull()).coalesce(1).write.mode(mode).text(f"{path}-summary")


def write_metadata(spark: SparkSession, meta: dict, path: str, mode: str = "error") -> None:
    """Model metadata (features, threshold, target) as a one-row text table of JSON."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
