"""Log text to correlated transmissions with measurements and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio
from ..operators import correlate, metrics
from ..session import materialize
from ..sources import logs

DL_VALUES = ["dl_rsrp", "dl_rsrq", "dl_sinr"]


def read_transmissions(spark: SparkSession, path, **options) -> DataFrame:
    """Log files to finished transmissions."""
    return transmissions_from_lines(logs.number_lines(spark, path).where(F.col("value") != ""), **options)


def transmissions_from_lines(lines: DataFrame, window_ms: float = 50, mode: str = "consume", unmatched: str = "dtx",
                             skip_measurements: bool = False, compat_duplicate_unmatched: bool = False) -> DataFrame:
    """Numbered lines to finished transmissions.

    ``mode`` is ``consume`` (feedback retires a transmission) or ``first`` (first feedback in the window).
    The lines that matter are stored once, then the events; every later step reads those.
    """
    lines = logs.needed_lines(lines)
    events = materialize(logs.classified(lines), "events")
    tx, fb = logs.pdsch_events(events), logs.harq_events(events).drop("tbs")
    if mode == "consume":
        matched = correlate.consuming_feedback(
            tx, fb, window_ms, compat_duplicate_unmatched=compat_duplicate_unmatched
        )
    else:
        matched = correlate.first_feedback(tx, fb, window_ms)
    if skip_measurements:
        measured = matched.withColumns({c: F.lit(None).cast("double") for c in [*DL_VALUES, "ul_sinr"]})
    else:
        measured = correlate.bucket_measurement(matched, logs.dl_measurements(lines, stored=True), DL_VALUES)
        measured = correlate.bucket_measurement(measured, logs.ul_measurements(events), ["ul_sinr"])
    return finish(measured, unmatched)


def finish(measured: DataFrame, unmatched: str = "dtx") -> DataFrame:
    """Labels, relative time, running error rate, throughput and cumulative columns per source file."""
    labelled = correlate.label_feedback(measured, unmatched)
    timed = metrics.throughput_columns(metrics.relative_time(labelled))
    # One chunked pass gives the running error rate and both cumulative sums.
    run = metrics.running_sums(timed, ["file"], ["ts", "block", "pos", "harq_timestamp"], {
        "_nack": (F.coalesce(F.col("ack_status"), F.lit(-1.0)) == 0).cast("bigint"), "_n": F.lit(1),
        "cumulative_throughput_mbits": F.col("instantaneous_throughput_mbps"),
        "cumulative_trueput_mbits": F.col("instantaneous_trueput_mbps"),
    })
    rated = run.withColumn("bler", F.col("_nack") / F.col("_n") * 100).drop("_nack", "_n")
    second = F.floor("pdsch_time_relative_s").cast("bigint")
    rated = rated.withColumn("window_start_time", second)
    summed = correlate.back_join_totals(rated, ["file", "window_start_time"], {
        "throughput_mbps_per_sec": F.sum("instantaneous_throughput_mbps"),
        "trueput_mbps_per_sec": F.sum("instantaneous_trueput_mbps"),
    })
    keyed = summed.withColumns({
        "harq_process_key": F.concat_ws("_", F.col("ue_id").cast("string"), radio.rnti_text("rnti"), F.col("harq_id").cast("string")),
        "rnti": radio.rnti_text("rnti"),
    })
    return keyed.withColumnsRenamed({"ts": "pdsch_timestamp"}).drop("block", "pos", "ack")
