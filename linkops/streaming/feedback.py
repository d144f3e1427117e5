"""Transmissions and feedback correlated on the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feedback_join(tx: DataFrame, fb: DataFrame, window: str = "50 milliseconds", delay: str = "1 second",
                  keys=("ue_id", "rnti", "harq_id")) -> DataFrame:
    """Left outer interval join. A transmission without feedback leaves once the watermark passes its window.

    Every feedback in the window gives a row; :func:`linkops.operators.correlate.label_feedback` names the
    unmatched ones.
    """
    left = tx.withWatermark("ts", delay)
    right = fb.select(
        F.col("ts").alias("harq_timestamp"), "ack", *[F.col(k).alias(f"_k_{k}") for k in keys]
    ).withWatermark("harq_timestamp", delay)
    match = (F.col("harq_timestamp") >= F.col("ts")) & (F.col("harq_timestamp") <= F.col("ts") + F.expr(f"interval {window}"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(right, match, "leftOuter").drop(*[f"_k_{k}" for k in keys])
