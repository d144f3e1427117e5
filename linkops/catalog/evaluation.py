"""Evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, metrics
from ..plans import decision_flow
from ..session import scratch_path
from ..sources import sinks
from .luts import EMPIRICAL, _empirical
from .registry import query
from .tables import ROW_KEY, TX, table, transmissions

PRIORITY = "ep AS (SELECT tx.*, o_orderpriority AS slice FROM tx JOIN orders ON o_orderkey = tx.l_orderkey)"


def _sliced(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("slice"))
    return transmissions(spark, sf_dir).join(orders, "l_orderkey")


_LOSS = """avg(-(label_pass * ln(p + 1e-9) + (1 - label_pass) * ln(1 - p + 1e-9))) AS logloss, avg(CAST((p >= 0.5) = (label_pass >= 0.5) AS DOUBLE)) AS accuracy"""


@query("E1_log_loss", f"WITH {TX} SELECT {_LOSS} FROM tx", "logloss accuracy")
def log_loss(spark, sf_dir):
    return evaluate.log_loss(transmissions(spark, sf_dir))


_ERRORS = "count(*) AS rows, avg(abs(p - label_pass)) AS mae, avg((p - label_pass) ** 2) AS mse, sqrt(avg((p - label_pass) ** 2)) AS rmse"


@query("E2_probability_errors", f"WITH {TX} SELECT {_ERRORS} FROM tx", "mae mse rmse")
def probability_errors(spark, sf_dir):
    return evaluate.probability_errors(transmissions(spark, sf_dir))


def _rel(bins, source="tx", key=""):
    keys = f"{key}, " if key else ""
    on = "USING (slice, bin)" if key else "USING (bin)"
    grid = f"(SELECT DISTINCT slice FROM {source}) CROSS JOIN range(0, {bins}) r(v)" if key else f"range(0, {bins}) r(v)"
    return f"""b AS (SELECT {keys}CAST(least(floor(p * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS count, avg(p) AS pred_mean, avg(label_pass) AS true_rate FROM {source} GROUP BY ALL),
g AS (SELECT {keys}CAST(v AS INTEGER) AS bin FROM {grid}),
rel AS (SELECT {keys}bin, bin / {bins} AS bin_lower, (bin + 1) / {bins} AS bin_upper, coalesce(pred_mean, 0) AS pred_mean, coalesce(true_rate, 0) AS true_rate, coalesce(count, 0) AS count FROM g LEFT JOIN b {on})"""


@query("E3_reliability", f"WITH {TX}, {_rel(15)} SELECT * FROM rel", "bin_lower bin_upper pred_mean true_rate")
def reliability(spark, sf_dir):
    return evaluate.reliability(transmissions(spark, sf_dir))


@query("E3_calibration_error", f"WITH {TX}, {_rel(15)} SELECT sum(abs(true_rate - pred_mean) * count) / sum(count) AS ece FROM rel", "ece")
def calibration_error(spark, sf_dir):
    return evaluate.calibration_error(evaluate.reliability(transmissions(spark, sf_dir)))


@query("E4_wilson_interval", f"""WITH {TX}, {_rel(40)}, x AS (SELECT bin, count, true_rate, 3.8416::DOUBLE AS z2, CASE WHEN count = 0 THEN NULL ELSE count END AS n FROM rel)
SELECT bin, count, true_rate,
  CASE WHEN count = 0 THEN 0 ELSE greatest(0, (true_rate + z2 / (2 * n) - 1.96::DOUBLE * sqrt(true_rate * (1 - true_rate) / n + z2 / (4 * n * n))) / (1 + z2 / n)) END AS ci_lo,
  CASE WHEN count = 0 THEN 0 ELSE least(1, (true_rate + z2 / (2 * n) + 1.96::DOUBLE * sqrt(true_rate * (1 - true_rate) / n + z2 / (4 * n * n))) / (1 + z2 / n)) END AS ci_hi FROM x""", "true_rate ci_lo ci_hi")
def wilson_interval(spark, sf_dir):
    table_ = evaluate.wilson(evaluate.reliability(transmissions(spark, sf_dir), 40))
    return table_.select("bin", "count", "true_rate", "ci_lo", "ci_hi")


@query("E5_slice_metrics", f"WITH {TX}, {PRIORITY}, top AS (SELECT slice FROM ep GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) SELECT slice, {_ERRORS} FROM ep JOIN top USING (slice) GROUP BY 1", "mae mse rmse")
def slice_metrics(spark, sf_dir):
    return evaluate.slice_metrics(_sliced(spark, sf_dir), "slice", 3)


@query("E5_slice_reliability", f"WITH {TX}, {PRIORITY}, {_rel(8, 'ep', 'slice')} SELECT * FROM rel", "bin_lower bin_upper pred_mean true_rate")
def slice_reliability(spark, sf_dir):
    return evaluate.slice_reliability(_sliced(spark, sf_dir), "slice", 15, 8)


_POINTS = """d AS (SELECT 1 - p AS score, sum(1 - label_pass) AS pos, sum(label_pass) AS neg FROM tx GROUP BY 1),
pts AS (SELECT score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM d),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM d)"""


def _points(spark, sf_dir):
    return evaluate.curve_points(transmissions(spark, sf_dir), 1 - F.col("p"), 1 - F.col("label_pass"))


@query("W9_cumulative_by_score", f"WITH {TX}, {_POINTS} SELECT * FROM pts")
def cumulative_by_score(spark, sf_dir):
    return _points(spark, sf_dir)


@query("E6_roc_pr_curve", f"""WITH {TX}, {_POINTS} SELECT score, tp / tot.p AS tpr, fp / tot.n AS fpr, tp / (tp + fp) AS precision, tp / tot.p AS recall FROM pts, tot""", "tpr fpr precision recall")
def roc_pr_curve(spark, sf_dir):
    return evaluate.roc_pr(_points(spark, sf_dir))


@query("E6_areas", f"""WITH {TX}, {_POINTS} SELECT sum(pts.neg / tot.n * (tp + tp - pts.pos) / tot.p / 2) AS roc_auc, sum(pts.pos / tot.p * tp / (tp + fp)) AS average_precision FROM pts, tot""", "roc_auc average_precision")
def areas(spark, sf_dir):
    return evaluate.areas(_points(spark, sf_dir))


_GRID = ", ".join(f"({t!r}::DOUBLE)" for t in evaluate.calibration_grid())


def _curve(source="tx", key=""):
    k = f"{key}, " if key else ""
    on = f"s.{key} = g.{key} AND " if key else ""
    gk = f"g.{key}, " if key else ""
    total = "any_value(g.total)"
    if key:
        g = f"(SELECT {key}, count(*) AS total FROM {source} GROUP BY 1) CROSS JOIN thr"
    else:
        g = f"(SELECT count(*) AS total FROM {source}) CROSS JOIN thr"
    return f"""thr(threshold) AS (VALUES {_GRID}), g AS (SELECT {k}threshold, total FROM {g}),
curve AS (SELECT {gk}g.threshold, count(s.p) / {total} AS accept_rate, coalesce(avg(CAST(s.label_pass < 0.5 AS DOUBLE)), 0) AS violation,
  coalesce(avg(s.tbs * s.label_pass), 0) AS obs_throughput, coalesce(avg(s.tbs * s.p), 0) AS exp_throughput
  FROM g LEFT JOIN {source} s ON {on}s.p >= g.threshold GROUP BY ALL)"""


_CURVE_ROUND = "accept_rate violation obs_throughput exp_throughput"


@query("E7_tradeoff", f"WITH {TX}, {_curve()} SELECT * FROM curve", _CURVE_ROUND, digits=5)
def tradeoff(spark, sf_dir):
    return evaluate.tradeoff(transmissions(spark, sf_dir), evaluate.calibration_grid())


@query("E8_tradeoff_by_slice", f"WITH {TX}, {PRIORITY}, {_curve('ep', 'slice')} SELECT * FROM curve", _CURVE_ROUND, digits=5)
def tradeoff_by_slice(spark, sf_dir):
    return evaluate.slice_tradeoff(_sliced(spark, sf_dir), "slice", evaluate.calibration_grid())


@query("E9_row_at_threshold", f"WITH {TX}, {_curve()} SELECT * FROM curve ORDER BY abs(threshold - 0.65::DOUBLE), threshold DESC LIMIT 1", _CURVE_ROUND, digits=5)
def row_at_threshold(spark, sf_dir):
    return evaluate.row_at(evaluate.tradeoff(transmissions(spark, sf_dir), evaluate.calibration_grid()), 0.65)


@query("E9_worst_slice", f"WITH {TX}, {PRIORITY}, {_curve('ep', 'slice')} SELECT slice, violation, accept_rate FROM curve WHERE threshold = 0.65::DOUBLE ORDER BY violation DESC, slice LIMIT 1", "violation accept_rate", digits=5)
def worst_slice(spark, sf_dir):
    curve = evaluate.slice_tradeoff(_sliced(spark, sf_dir), "slice", evaluate.calibration_grid())
    return evaluate.worst_slice(curve, "slice", 0.65)


@query("M5_calibrated_threshold", f"""WITH {TX}, {_curve()} SELECT threshold, violation, accept_rate FROM curve
ORDER BY violation <= 0.1::DOUBLE DESC, CASE WHEN violation <= 0.1::DOUBLE THEN accept_rate ELSE -abs(violation - 0.1::DOUBLE) END DESC, threshold DESC LIMIT 1""", "violation accept_rate")
def calibrated_threshold(spark, sf_dir):
    curve = evaluate.tradeoff(transmissions(spark, sf_dir), evaluate.calibration_grid(), tbs=None)
    return evaluate.calibrated_threshold(curve, 0.1)


_CLASSES = "cl AS (SELECT mcs AS truth, CAST((mcs + l_linenumber % 3) % 28 AS INTEGER) AS pred, CAST((mcs + l_linenumber % 2) % 28 AS INTEGER) AS second FROM tx)"


def _classes(spark, sf_dir):
    line = F.col("l_linenumber")
    return transmissions(spark, sf_dir).select(
        F.col("mcs").alias("truth"), F.pmod(F.col("mcs") + F.pmod(line, F.lit(3)), F.lit(28)).cast("int").alias("pred"),
        F.pmod(F.col("mcs") + F.pmod(line, F.lit(2)), F.lit(28)).cast("int").alias("second"),
    )


@query("E10_class_metrics", f"WITH {TX}, {_CLASSES} SELECT avg(CAST(truth = pred AS DOUBLE)) AS accuracy, avg(abs(truth - pred)) AS mae, avg(CAST(truth IN (pred, second) AS DOUBLE)) AS top2_accuracy FROM cl", "accuracy mae top2_accuracy")
def class_metrics(spark, sf_dir):
    rows = _classes(spark, sf_dir).withColumn("ranked", F.array("pred", "second"))
    return evaluate.class_metrics(rows, "truth", "pred", "ranked")


@query("E11_class_report", f"""WITH {TX}, {_CLASSES}, a AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = pred) AS hits FROM cl GROUP BY 1),
b AS (SELECT pred AS class, count(*) AS predicted FROM cl GROUP BY 1),
c AS (SELECT class, coalesce(support, 0) AS support, coalesce(hits, 0) / nullif(predicted, 0) AS pr, coalesce(hits, 0) / nullif(support, 0) AS re FROM a FULL JOIN b USING (class))
SELECT class, coalesce(pr, 0) AS precision, coalesce(re, 0) AS recall, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1, support FROM c""", "precision recall f1")
def class_report(spark, sf_dir):
    return evaluate.class_report(_classes(spark, sf_dir), "truth", "pred")


@query("E12_one_vs_rest_areas", f"""WITH {TX}, d AS (SELECT p AS score, count(*) FILTER (ack_status = 1) AS pos, count(*) FILTER (ack_status <> 1) AS neg FROM tx GROUP BY 1),
pts AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM d), tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM d)
SELECT sum(pts.neg / tot.n * (tp + tp - pts.pos) / tot.p / 2) AS roc_auc, sum(pts.pos / tot.p * tp / (tp + fp)) AS average_precision FROM pts, tot""", "roc_auc average_precision")
def one_vs_rest(spark, sf_dir):
    tx = transmissions(spark, sf_dir)
    return evaluate.areas(evaluate.curve_points(tx, F.col("p"), F.col("ack_status") == 1))


@query("E13_prediction_export", f"WITH {TX} SELECT label_pass, count(*) AS rows, avg(p) AS p, CAST(sum(tbs) AS BIGINT) AS tbs FROM tx GROUP BY 1", "p")
def prediction_export(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(transmissions(spark, sf_dir).withColumnRenamed("p", "pred_prob"), path, ["snr", "cqi", "mcs"])
    return spark.read.parquet(path).groupBy("label_pass").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("pred_prob").alias("p"), F.sum("tbs").alias("tbs")
    )


@query("E14_lut_comparison", f"WITH {EMPIRICAL} SELECT snr_code, cqi_code, mcs AS lut_mcs, CAST(mcs + 1 AS INTEGER) AS model_mcs FROM emp WHERE cqi_code IN (0, 4, 8, 12, 15)")
def lut_comparison(spark, sf_dir):
    table_ = _empirical(spark, sf_dir)
    return evaluate.compare_luts(table_, table_.withColumn("mcs", F.col("mcs") + 1))


@query("S16_report", f"""WITH {TX}, {_curve()}, a AS (SELECT threshold, accept_rate FROM curve ORDER BY abs(threshold - 0.65::DOUBLE), threshold DESC LIMIT 1)
SELECT {_LOSS}, any_value(a.threshold) AS threshold, any_value(a.accept_rate) AS accept_rate FROM tx, a""", "logloss accuracy accept_rate")
def report(spark, sf_dir):
    parts = decision_flow.evaluation(
        _sliced(spark, sf_dir).select(*ROW_KEY, "p", "label_pass", "tbs", "slice"), 0.65, "slice"
    )
    path = scratch_path(spark, "report")
    sinks.write_report(sinks.report_row(parts["losses"], parts["at_threshold"], parts["worst_slice"]), path)
    back = spark.read.json(path)
    return back.select("predictive.logloss", "predictive.accuracy", "at_threshold.threshold", "at_threshold.accept_rate")


@query("S16_report_summary_lines", f"WITH {TX} SELECT 1 AS lines FROM tx LIMIT 1")
def report_lines(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(sinks.report_row(evaluate.log_loss(transmissions(spark, sf_dir))), path)
    return spark.read.text(f"{path}-summary").agg(F.count(F.lit(1)).cast("int").alias("lines"))


@query("A21_confusion_counts", f"WITH {TX}, {_CLASSES} SELECT truth AS true_class, pred AS pred_class, count(*) AS count FROM cl GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return metrics.confusion(_classes(spark, sf_dir), "truth", "pred")
