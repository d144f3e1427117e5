"""Fitted models over the transmission features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.expr import hash_fraction, round_share
from ..operators import candidates, evaluate, lut, metrics, modelling, policy, sampling
from ..session import materialize, scratch_path, spread
from ..sources import sinks
from .registry import query
from .tables import MCS, ROW_KEY, TX, transmissions

FEATURES = ["snr", "cqi", "mcs"]
# Labelled rows a model is fitted on at most, chosen by a hash, unless it takes the whole of them; scoring always takes
# all rows.
TRAINING_ROWS = 20_000
_FITTED: dict[tuple, str] = {}


def _rows(spark, sf_dir):
    """Transmissions with a hashed ``split``; a fifth is held out."""
    return sampling.random_split(transmissions(spark, sf_dir), 0.2, ROW_KEY)


def _training(rows):
    """At most about ``TRAINING_ROWS`` of the training rows."""
    rows = rows.where("split = 'train'")
    share = TRAINING_ROWS / max(rows.count(), 1)
    return rows if share >= 1 else rows.where(hash_fraction(ROW_KEY, 7) < share)


def _model(spark, sf_dir, whole=False, **kw):
    """The pass model at the library's settings; fitted once per session and data, then read from its folder. ``whole``
    fits it on all training rows."""
    key = (spark.sparkContext.applicationId, sf_dir, *(["whole"] if whole else []), *sorted(kw.items()))
    if key not in _FITTED:
        path = scratch_path(spark, "pass-model")
        rows = _rows(spark, sf_dir)
        rows = rows.where("split = 'train'") if whole else _training(rows)
        modelling.save_model(modelling.train_pass_model(rows, FEATURES, ROW_KEY, **kw), path)
        _FITTED[key] = path
    return modelling.load_model(_FITTED[key])


def _scored(spark, sf_dir, **kw):
    return modelling.score(_model(spark, sf_dir, **kw), _rows(spark, sf_dir).drop("p"), FEATURES)


def _held_out_loss(scored, spark, sf_dir):
    """All rows scored, and whether the held-out rows have a lower loss than their base rate gives."""
    test = scored.where("split = 'test'")
    base = test.agg(F.avg(F.col("label_pass").cast("double")).alias("r")).first()["r"]
    loss = evaluate.log_loss(test).first()["logloss"]
    flat = -(base * math.log(base) + (1 - base) * math.log(1 - base))
    return scored.agg(F.count("p").alias("rows")).withColumn("better_than_base_rate", F.lit(loss < flat))


_BETTER = "SELECT count(*) AS rows, true AS better_than_base_rate FROM lineitem"


@query("M1_pass_model", _BETTER)
def pass_model(spark, sf_dir):
    return _held_out_loss(_scored(spark, sf_dir), spark, sf_dir)


@query("M1_logistic_pass_model", _BETTER)
def logistic_model(spark, sf_dir):
    return _held_out_loss(_scored(spark, sf_dir, kind="logistic"), spark, sf_dir)


@query("M2_class_balance", f"WITH {TX} SELECT label_pass, count(*) AS rows, avg(CASE WHEN label_pass = 1 THEN (SELECT count(*) FILTER (label_pass = 0) / count(*) FILTER (label_pass = 1) FROM tx) ELSE 1 END) AS weight FROM tx GROUP BY 1", "weight")
def class_balance(spark, sf_dir):
    weighted = modelling.balance_weights(transmissions(spark, sf_dir))
    return weighted.groupBy("label_pass").agg(F.count(F.lit(1)).alias("rows"), F.avg("weight").alias("weight"))


def _with_best(rows):
    """Label of the class models: best MCS of the closed-form probability."""
    probability = lambda m: round_share(1 / (1 + F.exp(-(0.6 * (F.col("snr") - (m * 0.9 - 9.0))))))
    df = candidates.candidates(rows, probability, unrolled=True)
    return df.withColumn("best", policy.best_throughput()["mcs"]).drop("cand")


def _best(spark, sf_dir):
    return _with_best(_rows(spark, sf_dir))


def _stored_best(spark, sf_dir):
    """What the polynomial fits read, which is several times: stored, so that each label is worked out once."""
    return materialize(_with_best(spread(_rows(spark, sf_dir).select("snr", "cqi", "split"))), "best")


def _classifier(df, kind="forest"):
    return modelling.train_classifier(df, ["snr", "cqi"], "best", kind=kind)


@query("M3_E10_mcs_classifier")
def mcs_classifier(spark, sf_dir):
    rows = _best(spark, sf_dir)
    predicted = modelling.classify(_classifier(_training(rows)), rows.where("split = 'test'"), ranked="ranked")
    return evaluate.class_metrics(predicted, "best", "predicted", "ranked")


@query("M6_E11_label_classifier")
def label_classifier(spark, sf_dir):
    rows = _best(spark, sf_dir)
    inputs = ["snr", "cqi", "ele_angle", "bler", "target_bler", "ue_id", "harq_id", "nrtx"]
    model = modelling.train_classifier(_training(rows), inputs, "best")
    return evaluate.class_report(modelling.classify(model, rows.where("split = 'test'")), "best", "predicted")


@query("M4_monotone_scores")
def monotone_scores(spark, sf_dir):
    model = _model(spark, sf_dir, whole=True)
    rows = candidates.contexts(transmissions(spark, sf_dir), ["snr", "cqi"])
    packed = candidates.score_contexts(materialize(rows, "contexts"), ["snr", "cqi"], modelling.scorer(model, FEATURES))
    lowered = packed.withColumn("cand", modelling.monotone_probability("cand"))
    chosen = lowered.select("n", policy.threshold_choice(0.7)["mcs"].alias("mcs"))
    return metrics.distribution(chosen, "mcs", weight="n")


@query("M9_feature_importance", "SELECT 3 AS features, 1.0::DOUBLE AS gain FROM lineitem LIMIT 1", "gain")
def feature_importance(spark, sf_dir):
    """Gains of all features; together they are the whole gain."""
    rows = spark.createDataFrame(modelling.feature_importance(_model(spark, sf_dir), FEATURES), "feature string, gain double, splits int")
    return rows.agg(F.count_distinct("feature").cast("int").alias("features"), F.sum("gain").alias("gain"))


@query("M9_feature_splits")
def feature_splits(spark, sf_dir):
    """Gain and number of splits of every feature, from the table of nodes that the model is stored as."""
    model = _model(spark, sf_dir)
    path = _FITTED[(spark.sparkContext.applicationId, sf_dir)]
    return modelling.split_importance(spark, model, path, FEATURES)


# Newton steps of a logistic regression over the different contexts: coefficients of 1, snr, cqi and mcs.
_LOGISTIC_SQL = f"""{TX},
c AS (SELECT 1.0::DOUBLE AS x0, snr AS x1, CAST(cqi AS DOUBLE) AS x2, CAST(mcs AS DOUBLE) AS x3, count(*) AS n, CAST(sum(label_pass) AS DOUBLE) AS s FROM tx GROUP BY ALL),
newton(k, b) AS (SELECT 0, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]
  UNION ALL SELECT k + 1, list_transform(range(1, 5), lambda i: b[i] + m[i][5]) FROM (
  {{solved}}) WHERE k < 25),
fit AS (SELECT b FROM newton WHERE k = 25)"""


def _logistic_sql() -> str:
    w = "n * p * (1 - p)"
    rows = ", ".join("[" + ", ".join([*[f"sum({w} * x{i} * x{j})" for j in range(4)], f"sum((s - n * p) * x{i})"]) + "]" for i in range(4))
    inner = f"SELECT k, b, [{rows}] AS m FROM (SELECT *, 1 / (1 + exp(-(b[1] * x0 + b[2] * x1 + b[3] * x2 + b[4] * x3))) AS p FROM newton, c) GROUP BY k, b"
    for at in range(1, 5):
        inner = f"""SELECT k, b, list_transform(range(1, 5), lambda i: list_transform(range(1, 6), lambda j:
    CASE WHEN i = {at} THEN m[{at}][j] / m[{at}][{at}] ELSE m[i][j] - m[i][{at}] * m[{at}][j] / m[{at}][{at}] END)) AS m FROM ({inner})"""
    return _LOGISTIC_SQL.replace("{solved}", inner)


_P_SQL = "1 / (1 + exp(-(b[1] + b[2] * snr + b[3] * cqi + b[4] * mcs)))"


def _logistic(spark, sf_dir):
    """Logistic pass model over all transmissions, stored once per session and data."""
    key = (spark.sparkContext.applicationId, sf_dir, "all rows")
    if key not in _FITTED:
        path = scratch_path(spark, "logistic-model")
        rows = transmissions(spark, sf_dir)
        modelling.save_model(modelling.train_pass_model(rows, FEATURES, ROW_KEY, kind="logistic", tolerance=1e-14), path)
        _FITTED[key] = path
    return modelling.load_model(_FITTED[key])


@query("M1_logistic_all_rows", f"""WITH RECURSIVE {_logistic_sql()}, p AS (SELECT label_pass AS y, greatest(least({_P_SQL}, 1 - 1e-9), 1e-9) AS p FROM tx, fit)
SELECT b[1] AS intercept, b[2] AS snr, b[3] AS cqi, b[4] AS mcs, (SELECT -avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) FROM p) AS logloss FROM fit""", "intercept snr cqi mcs logloss", digits=5)
def logistic_all_rows(spark, sf_dir):
    """Coefficients of the logistic model over all rows, and its loss on them."""
    model = _logistic(spark, sf_dir)
    rows = modelling.score(model, transmissions(spark, sf_dir).drop("p"), FEATURES)
    fit = model.stages[-1]  # four numbers
    named = zip(["intercept", *FEATURES], [fit.intercept, *fit.coefficients.toArray().tolist()])
    return evaluate.log_loss(rows).select(*[F.lit(float(v)).alias(n) for n, v in named], "logloss")


@query("M10_logistic_scoring", f"WITH RECURSIVE {_logistic_sql()} SELECT mcs, count(*) AS rows, avg({_P_SQL}) AS p FROM tx, fit GROUP BY 1", "p", digits=5)
def logistic_scoring(spark, sf_dir):
    scored = modelling.score(_logistic(spark, sf_dir), transmissions(spark, sf_dir).drop("p"), FEATURES)
    return scored.groupBy("mcs").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("p"))


@query("M10_recommend_logistic", f"""WITH RECURSIVE {_logistic_sql()}, {MCS},
w AS (SELECT snr, cqi, m.mcs AS m, m.eff / (1 + exp(-(b[1] + b[2] * snr + b[3] * cqi + b[4] * m.mcs))) AS t FROM (SELECT DISTINCT snr, cqi FROM tx), mcs_table m, fit),
best AS (SELECT snr, cqi, arg_max(m, (t, -m)) AS rec_mcs FROM w GROUP BY 1, 2), n AS (SELECT rec_mcs, count(*) AS count FROM tx JOIN best USING (snr, cqi) GROUP BY 1)
SELECT rec_mcs, count, count * 100.0::DOUBLE / sum(count) OVER () AS percent FROM n""", "percent")
def recommend_logistic(spark, sf_dir):
    """Recommendations of the throughput policy by the logistic model, over distinct contexts."""
    rows = transmissions(spark, sf_dir).drop("p", "mcs", "u")
    packed = candidates.score_contexts(rows, ["snr", "cqi"], modelling.scorer(_logistic(spark, sf_dir), FEATURES))
    return metrics.distribution(policy.recommend(packed, "throughput"), "rec_mcs")


@query("M11_logistic_round_trip", f"WITH RECURSIVE {_logistic_sql()} SELECT CAST(cqi AS INTEGER) AS cqi, avg({_P_SQL}) AS p FROM tx, fit GROUP BY 1", "p", digits=5)
def logistic_round_trip(spark, sf_dir):
    """Scores of a model that was stored with its metadata, read again and given its features from there."""
    path = scratch_path(spark, "model")
    modelling.save_model(_logistic(spark, sf_dir), path)
    sinks.write_metadata(spark, {"features": FEATURES, "threshold": 0.5, "calibrate_target": 0.1}, f"{path}-meta")
    meta = sinks.read_metadata(spark, f"{path}-meta")
    scored = modelling.score(modelling.load_model(path), transmissions(spark, sf_dir).drop("p"), meta["features"])
    return scored.groupBy("cqi").agg(F.avg("p").alias("p"))


@query("M10_batch_scoring", "SELECT count(*) AS rows, 0::BIGINT AS outside FROM lineitem")
def batch_scoring(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("p").between(0, 1)).cast("long")).alias("outside"))


@query("M10_recommend_with_model")
def recommend_with_model(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = transmissions(spark, sf_dir).drop("p", "mcs", "u")
    packed = candidates.score_contexts(rows, ["snr", "cqi"], modelling.scorer(model, FEATURES))
    return metrics.distribution(policy.recommend(packed, "throughput"), "rec_mcs")


@query("M11_model_round_trip", "SELECT count(*) AS rows, 0::BIGINT AS differing FROM lineitem")
def model_round_trip(spark, sf_dir):
    """Save, describe and load a model; rows whose score differs afterwards are counted."""
    path, scored = scratch_path(spark, "model"), _scored(spark, sf_dir)
    modelling.save_model(_model(spark, sf_dir), path)
    curve = evaluate.tradeoff(scored, evaluate.calibration_grid(), tbs=None)
    # One row: the calibrated threshold.
    best = evaluate.calibrated_threshold(curve, 0.1).first()
    sinks.write_metadata(spark, {"features": FEATURES, "threshold": best["threshold"], "calibrate_target": 0.1}, f"{path}-meta")
    meta = sinks.read_metadata(spark, f"{path}-meta")
    back = modelling.score(modelling.load_model(path), scored.withColumnRenamed("p", "before"), meta["features"])
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("p").eqNullSafe(F.col("before"))).cast("long")).alias("differing"))


@query("L3_classifier_lut")
def classifier_lut(spark, sf_dir):
    rows = _best(spark, sf_dir)
    model = _classifier(_training(rows), "logistic")
    return lut.classifier_lut(rows, lambda bins: modelling.classify(model, bins, "mcs"), min_count=1, fill=(0, 15))


# --- closed-form fits ------------------------------------------------------------------------------

_BEST = """best AS (SELECT CAST(round_even(snr * 10, 0) AS BIGINT) AS code, max(mcs) AS m, avg(bler) AS bler FROM tx WHERE blkerr = 1 GROUP BY 1)"""


def _best_per_snr(spark, sf_dir):
    return metrics.best_mcs_per_snr(transmissions(spark, sf_dir), ["bler"], [], ["ts", *ROW_KEY])


@query("M7_linear_curve", f"""WITH {TX}, {_BEST}, f AS (SELECT regr_slope(m, bler) AS a, regr_intercept(m, bler) AS b, median(bler) AS mid FROM best)
SELECT s.v / 10.0::DOUBLE AS snr, CAST(greatest(0, round_even(b + a * coalesce(best.bler, mid), 0)) AS INTEGER) AS predicted_mcs
FROM range(-80, 51) s(v) LEFT JOIN best ON best.code = s.v CROSS JOIN f""")
def linear_curve(spark, sf_dir):
    best = _best_per_snr(spark, sf_dir)
    fit = modelling.linear_fit(best, "optimal_mcs", "bler")
    return modelling.linear_curve(best, spark, fit["slope"], fit["intercept"])


@query("M7_linear_fit_quality", f"WITH {TX}, {_BEST} SELECT count(*) AS rows, regr_r2(m, bler) AS r2, sqrt(regr_syy(m, bler) * (1 - regr_r2(m, bler)) / count(*)) AS rmse FROM best", "r2 rmse")
def linear_fit_quality(spark, sf_dir):
    best = _best_per_snr(spark, sf_dir)
    fit = modelling.linear_fit(best, "optimal_mcs", "bler")
    return modelling.fit_quality(best, "optimal_mcs", F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("bler")).select("rows", "r2", "rmse")


def _least_squares_sql(source: str, y: str, axes: dict[str, str], degree: int) -> str:
    """CTEs ``ranges`` (one row: centre and half width of each axis) and ``fit`` (one row: list ``c`` of coefficients in
    scaled variables, in the order of the exponents): moments of the scaled terms and Gauss-Jordan steps on them."""
    names, terms = list(axes), modelling.exponents(len(axes), degree)
    n = len(terms)
    ranges = ", ".join(f"(min({x}) + max({x})) / 2 AS {a}_c, (max({x}) - min({x})) / 2 AS {a}_w" for a, x in axes.items())
    power = lambda e: " * ".join(["1.0::DOUBLE", *[f"z{i}" for i, p in enumerate(e) for _ in range(p)]])
    moments = ", ".join(
        "[" + ", ".join([*[f"sum({power(tuple(a + b for a, b in zip(s, t)))})" for t in terms], f"sum({power(s)} * y)"]) + "]" for s in terms
    )
    scaled = ", ".join(f"({axes[a]} - {a}_c) / {a}_w AS z{i}" for i, a in enumerate(names))
    step = f"""list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j:
      CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"""
    return f"""ranges AS (SELECT {ranges} FROM {source}), zs AS (SELECT {scaled}, CAST({y} AS DOUBLE) AS y FROM {source}, ranges),
gauss(k, m) AS (SELECT 1, [{moments}] FROM zs UNION ALL SELECT k + 1, {step} FROM gauss WHERE k <= {n}),
fit AS (SELECT list_transform(m, lambda r: r[{n + 1}]) AS c FROM gauss WHERE k = {n + 1})"""


def _polynomial_sql(axes: dict[str, str], degree: int) -> str:
    """Value of the fit of ``_least_squares_sql`` at columns named like the axes."""
    pieces = []
    for i, e in enumerate(modelling.exponents(len(axes), degree)):
        pieces.append(" * ".join([f"c[{i + 1}]", *[f"(({x} - {a}_c) / {a}_w)" for (a, x), p in zip(axes.items(), e) for _ in range(p)]]))
    return " + ".join(pieces)


_ELE, _PAIR = {"ele": "ele_angle"}, {"snr": "snr", "cqi": "cqi"}


@query("M8_quadratic_fit", f"""WITH RECURSIVE {TX}, {_least_squares_sql('tx', 'snr', _ELE, 2)}
SELECT ele_angle, {_polynomial_sql(_ELE, 2)} AS snr FROM (SELECT CAST(v AS DOUBLE) AS ele_angle FROM range(0, 91) g(v)), fit, ranges""", "snr")
def quadratic_fit(spark, sf_dir):
    fit = modelling.polynomial_fit(transmissions(spark, sf_dir), ["ele_angle"], "snr", 2)
    grid = lut.step_grid(spark, {"ele_angle": (0.0, 90.0, 1.0)})
    return grid.withColumn("snr", fit.column())


# Best MCS by expected throughput; equal products go to the lowest MCS.
_BEST_SQL = f"""{TX}, {MCS}, w AS (SELECT snr, m.mcs, round(1 / (1 + exp(-(0.6::DOUBLE * (snr - (m.mcs * 0.9::DOUBLE - 9.0::DOUBLE))))), 9) * m.eff AS t FROM (SELECT DISTINCT snr FROM tx) CROSS JOIN mcs_table m),
best AS (SELECT snr, arg_max(mcs, (t, -mcs)) AS best FROM w GROUP BY 1), labelled AS (SELECT tx.snr, CAST(tx.cqi AS DOUBLE) AS cqi, best.best FROM tx JOIN best USING (snr))"""


@query("M8_cubic_fit_all_rows", f"""WITH RECURSIVE {_BEST_SQL}, {_least_squares_sql('labelled', 'best', _PAIR, 3)},
e AS (SELECT CAST(best AS DOUBLE) AS y, {_polynomial_sql(_PAIR, 3)} AS f FROM labelled, fit, ranges)
SELECT count(*) AS rows, 1 - sum((y - f) ** 2) / (count(*) * var_pop(y)) AS r2, sqrt(sum((y - f) ** 2) / count(*)) AS rmse, avg(abs(y - f)) AS mae FROM e""", "r2 rmse mae")
def cubic_fit_all_rows(spark, sf_dir):
    rows = _stored_best(spark, sf_dir)
    return modelling.fit_quality(rows, "best", modelling.polynomial_fit(rows, ["snr", "cqi"], "best", 3).column())


@query("M8_cubic_fit_quality")
def cubic_fit(spark, sf_dir):
    rows = _stored_best(spark, sf_dir)
    fit = modelling.polynomial_fit(rows.where("split = 'train'"), ["snr", "cqi"], "best", 3)
    return modelling.fit_quality(rows.where("split = 'test'"), "best", fit.column())


@query("L5_fitted_polynomial_lut", f"""WITH RECURSIVE {_BEST_SQL}, {_least_squares_sql('labelled', 'best', _PAIR, 3)}, b AS (SELECT min(snr) AS lo, max(snr) AS hi FROM tx),
g AS (SELECT lo + i * 0.2::DOUBLE AS snr, CAST(q AS DOUBLE) AS cqi FROM b, range(0, CAST(ceil((hi + 0.1::DOUBLE - lo) / 0.2::DOUBLE) AS BIGINT)) r(i), range(0, 16) c(q))
SELECT snr, cqi, CAST(least(greatest(round_even({_polynomial_sql(_PAIR, 3)}, 0), 0), 27) AS INTEGER) AS mcs FROM g, fit, ranges""", "snr")
def fitted_polynomial_lut(spark, sf_dir):
    rows = _stored_best(spark, sf_dir)
    fit = modelling.polynomial_fit(rows, ["snr", "cqi"], "best", 3)
    low, high = rows.agg(F.min("snr"), F.max("snr")).first()
    grid = lut.step_grid(spark, {"snr": (low, high, 0.2), "cqi": (0.0, 15.0, 1.0)})
    return lut.polynomial_lut(grid, fit.column())
