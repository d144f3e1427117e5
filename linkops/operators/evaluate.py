"""Quality of scored rows: losses, reliability, threshold trade-offs, ROC/PR, class reports.

Scored frames carry ``p`` (pass probability) and ``label_pass`` (0/1), optionally ``tbs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, linspace
from .metrics import confusion
from .ordered import running_sums
from .sampling import top_slices


def log_loss(df: DataFrame, p: str = "p", label: str = "label_pass", eps: float = 1e-9, keys=()) -> DataFrame:
    y, q = F.col(label).cast("double"), F.col(p)
    loss = -(y * F.log(q + F.lit(eps)) + (1 - y) * F.log(1 - q + F.lit(eps)))
    hit = ((q >= 0.5) == (y >= 0.5)).cast("double")
    return df.groupBy(*keys).agg(F.avg(loss).alias("logloss"), F.avg(hit).alias("accuracy"))


def probability_errors(df: DataFrame, p: str = "p", label: str = "label_pass", keys=()) -> DataFrame:
    """Rows, MAE, MSE (Brier) and RMSE."""
    err = F.col(p) - F.col(label)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse")
    )
    return out.withColumn("rmse", F.sqrt("mse"))


def reliability(df: DataFrame, bins: int = 15, p: str = "p", label: str = "label_pass", keys=()) -> DataFrame:
    """Equal-width reliability table; p = 1 belongs to the last bin, empty bins stay with zeros,
    rows without a probability are in none."""
    keys = list(keys)
    df = df.where(F.col(p).isNotNull())
    q = clip(p, 0.0, 1.0)
    index = F.least(F.floor(q * bins), F.lit(bins - 1)).cast("int")
    sums = df.select(*keys, q.alias("_q"), F.col(label).cast("double").alias("_y"), index.alias("bin")).groupBy(
        *keys, "bin"
    ).agg(F.count(F.lit(1)).alias("count"), F.avg("_q").alias("pred_mean"), F.avg("_y").alias("true_rate"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = sums.select(*keys).distinct().select(*keys, every) if keys else df.sparkSession.range(1).select(every)
    table = grid.join(sums, [*keys, "bin"], "left").na.fill(0, ["count"]).na.fill(0.0, ["pred_mean", "true_rate"])
    return table.select(
        *keys, "bin", (F.col("bin") / bins).alias("bin_lower"), ((F.col("bin") + 1) / bins).alias("bin_upper"),
        "pred_mean", "true_rate", "count",
    )


def wilson(table: DataFrame, z: float = 1.96) -> DataFrame:
    """95 % Wilson interval of the rate in each bin; empty bins give 0..0."""
    n, r = F.col("count"), F.col("true_rate")
    z2 = z * z
    denom = 1 + F.lit(z2) / n
    center = r + F.lit(z2) / (2 * n)
    radius = F.lit(z) * F.sqrt(r * (1 - r) / n + F.lit(z2) / (4 * n * n))
    empty = n == 0
    return table.withColumns({
        "ci_lo": F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), (center - radius) / denom)),
        "ci_hi": F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), (center + radius) / denom)),
    })


def calibration_error(table: DataFrame, keys=()) -> DataFrame:
    gap = F.abs(F.col("true_rate") - F.col("pred_mean")) * F.col("count")
    return table.groupBy(*keys).agg((F.sum(gap) / F.sum("count")).alias("ece"))


def slice_metrics(df: DataFrame, column: str, k: int = 8, min_count: int = 1, p: str = "p",
                  label: str = "label_pass") -> DataFrame:
    """Probability errors of the most frequent slices (at most k rows of slices are joined)."""
    top = F.broadcast(top_slices(df, column, k, min_count).select(column))
    return probability_errors(df.join(top, column), p, label, [column])


def slice_reliability(df: DataFrame, column: str, bins: int = 15, k: int = 8, min_count: int = 1) -> DataFrame:
    top = F.broadcast(top_slices(df, column, k, min_count).select(column))
    return reliability(df.join(top, column), max(8, bins // 2), keys=[column])


# --- thresholds ------------------------------------------------------------------------------------

def calibration_grid() -> list[float]:
    return [round(x / 100, 2) for x in range(1, 100)]


def tradeoff_grid(steps: int = 99) -> list[float]:
    return linspace(0.01, 0.99, max(5, steps))


def thresholds_met(p, thresholds) -> Column:
    """How many of the evenly spaced ascending ``thresholds`` are <= p; the guess is corrected by comparison."""
    n, first = len(thresholds), thresholds[0]
    step = (thresholds[-1] - first) / (n - 1)
    q = F.col(p) if isinstance(p, str) else p
    padded = F.array(F.lit(float("-inf")), *[F.lit(t) for t in thresholds], F.lit(float("inf")))
    guess = F.least(F.greatest(F.floor((q - F.lit(first)) / F.lit(step)) + 1, F.lit(0)), F.lit(n)).cast("int")
    up = F.when(F.element_at(padded, guess + 2) <= q, 1).otherwise(0)
    down = F.when(F.element_at(padded, guess + 1) > q, 1).otherwise(0)
    return guess + up - down


def tradeoff(df: DataFrame, thresholds, p: str = "p", label: str | None = "label_pass", tbs: str | None = "tbs",
             keys=()) -> DataFrame:
    """Accept rate, violation and throughput at every threshold, per slice if ``keys`` are given.

    Rows are summed once per threshold band; the curve is a running sum over the bands, not a scan per threshold.
    """
    keys, thresholds = list(keys), sorted(float(t) for t in thresholds)
    prob, size = F.col(p), F.col(tbs).cast("double") if tbs else F.lit(0.0)
    fail = (1 - prob) if label is None else (F.col(label) < 0.5).cast("double")
    passed = F.lit(1.0) if label is None else (F.col(label) >= 0.5).cast("double")
    bands = df.groupBy(*keys, thresholds_met(prob, thresholds).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fail).alias("fail"), F.sum(size * passed).alias("obs"),
        F.sum(size * prob).alias("exp"),
    )
    grid = df.sparkSession.createDataFrame(
        [(i, t) for i, t in enumerate([None, *thresholds])], "band int, threshold double"
    )
    if keys:
        slices = bands.select(*keys).distinct()
        grid = slices.join(F.broadcast(grid))
    full = grid.join(bands, [*keys, "band"], "left").na.fill(0)
    down = Window.partitionBy(*keys).orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    run = full.select(
        *keys, "band", "threshold", F.sum("n").over(whole).alias("total"),
        *[F.sum(c).over(down).alias(c) for c in ("n", "fail", "obs", "exp")],
    ).where(F.col("band") > 0)

    def per_accepted(c):
        return F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))

    return run.select(
        *keys, "threshold", (F.col("n") / F.col("total")).alias("accept_rate"), per_accepted("fail").alias("violation"),
        per_accepted("obs").alias("obs_throughput"), per_accepted("exp").alias("exp_throughput"),
    )


def slice_tradeoff(df: DataFrame, column: str, thresholds, k: int = 8, min_count: int = 1, **names) -> DataFrame:
    top = F.broadcast(top_slices(df, column, k, min_count).select(column))
    return tradeoff(df.join(top, column), thresholds, keys=[column], **names)


def calibrated_threshold(curve: DataFrame, target: float) -> DataFrame:
    """Threshold with the largest accept rate whose violation meets the target, else the closest violation.

    Equal scores keep the higher threshold; nothing accepted counts as violation 0.
    """
    ok = F.col("violation") <= target
    score = F.struct(
        ok.cast("int").alias("ok"),
        F.when(ok, F.col("accept_rate")).otherwise(-F.abs(F.col("violation") - target)).alias("score"),
        F.col("threshold"),
    )
    return curve.agg(F.max_by(F.struct("threshold", "violation", "accept_rate"), score).alias("best")).select("best.*")


def row_at(curve: DataFrame, tau: float, keys=()) -> DataFrame:
    """Curve row whose threshold is nearest to tau (ties: the higher one)."""
    names = [c for c in curve.columns if c not in keys]
    distance = F.struct(F.abs(F.col("threshold") - tau), -F.col("threshold"))
    picked = curve.groupBy(*keys).agg(F.min_by(F.struct(*names), distance).alias("_r"))
    return picked.select(*keys, "_r.*")


def worst_slice(curve: DataFrame, column: str, tau: float) -> DataFrame:
    """Slice with the largest violation at tau (ties: the lower slice)."""
    rows = row_at(curve, tau, [column])
    # max_by on a text or numeric slice: order by violation, then keep the smallest slice.
    top = rows.agg(F.max("violation").alias("_v"))
    return rows.join(F.broadcast(top)).where(F.col("violation") == F.col("_v")).groupBy("violation").agg(
        F.min_by(F.struct(F.col(column).alias("slice"), "accept_rate"), column).alias("_s")
    ).select("_s.slice", "violation", "_s.accept_rate")


# --- ROC and PR ------------------------------------------------------------------------------------

def curve_points(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Cumulative true and false positives per distinct score, highest first. Equal scores form one point."""
    points = df.select(score.alias("score"), positive.cast("bigint").alias("pos")).groupBy("score").agg(
        F.sum("pos").alias("pos"), (F.count(F.lit(1)) - F.sum("pos")).alias("neg")
    ).withColumn("_desc", -F.col("score"))
    run = running_sums(points, [], ["_desc"], {"tp": F.col("pos"), "fp": F.col("neg")})
    return run.drop("_desc")


def roc_pr(points: DataFrame) -> DataFrame:
    """Curve rows with rates, precision and recall."""
    totals = points.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    p, n = F.greatest(F.col("_p"), F.lit(1)), F.greatest(F.col("_n"), F.lit(1))
    return points.join(F.broadcast(totals)).select(
        "score", (F.col("tp") / p).alias("tpr"), (F.col("fp") / n).alias("fpr"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / p).alias("recall"),
    )


def areas(points: DataFrame) -> DataFrame:
    """Trapezoid ROC area and step-wise average precision."""
    totals = points.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    p, n = F.greatest(F.col("_p"), F.lit(1)), F.greatest(F.col("_n"), F.lit(1))
    before = F.col("tp") - F.col("pos")
    rows = points.join(F.broadcast(totals))
    return rows.agg(
        F.sum(F.col("neg") / n * (F.col("tp") + before) / p / 2).alias("roc_auc"),
        F.sum(F.col("pos") / p * F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("average_precision"),
    )


# --- classes ---------------------------------------------------------------------------------------

def class_metrics(df: DataFrame, truth: str, predicted: str, ranked: str | None = None) -> DataFrame:
    """Accuracy, mean absolute step error and, from an array of classes best first, top-2 accuracy."""
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    aggs = [F.avg(hit).alias("accuracy"), F.avg(F.abs(F.col(truth) - F.col(predicted)).cast("double")).alias("mae")]
    if ranked:
        aggs.append(F.avg(F.array_contains(F.slice(ranked, 1, 2), F.col(truth)).cast("double")).alias("top2_accuracy"))
    return df.agg(*aggs)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = confusion(df, truth, predicted)
    # One row per class pair from here on.
    hits = F.when(F.col("true_class") == F.col("pred_class"), F.col("count")).otherwise(0)
    by_true = cells.groupBy(F.col("true_class").alias("class")).agg(F.sum("count").alias("support"), F.sum(hits).alias("hits"))
    by_pred = cells.groupBy(F.col("pred_class").alias("class")).agg(F.sum("count").alias("predicted"))
    both = by_true.join(by_pred, "class", "full").na.fill(0, ["support", "hits", "predicted"])
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return both.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def compare_luts(lut: DataFrame, predicted: DataFrame, cqi_codes=(0, 4, 8, 12, 15)) -> DataFrame:
    """Table entry beside the prediction along SNR for chosen CQI codes."""
    left = lut.where(F.col("cqi_code").isin(*cqi_codes)).withColumnRenamed("mcs", "lut_mcs")
    return left.join(predicted.withColumnRenamed("mcs", "model_mcs"), ["snr_code", "cqi_code"]).select(
        "snr_code", "cqi_code", "lut_mcs", "model_mcs"
    )
