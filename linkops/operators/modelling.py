"""Fits and Spark ML models of the decision flow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import hash_fraction
from .candidates import matrix, rebuilt


# --- closed-form fits ------------------------------------------------------------------------------

def linear_fit(df: DataFrame, y: str, x: str) -> dict[str, float]:
    row = df.agg(F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_r2(y, x)).first()
    return {"slope": row[0], "intercept": row[1], "r2": row[2]}


def linear_curve(best: DataFrame, spark, slope: float, intercept: float, low: float = -8.0, high: float = 5.0) -> DataFrame:
    """Predicted MCS per SNR code (0.1 dB); an SNR without data uses the median block-error rate."""
    codes = spark.range(round(low * 10), round(high * 10) + 1).select(F.col("id").alias("_code"))
    known = best.select(F.rint(F.col("snr_rounded") * 10).cast("bigint").alias("_code"), "bler")
    # ``best`` has one row per 0.1 dB, so the median is over a table of bounded size.
    middle = known.agg(F.median("bler").alias("_mid"))
    rate = F.coalesce("bler", "_mid")
    value = F.greatest(F.lit(0.0), F.rint(F.lit(float(intercept)) + F.lit(float(slope)) * rate))
    return codes.join(known, "_code", "left").join(F.broadcast(middle)).select(
        (F.col("_code") / 10.0).alias("snr"), value.cast("int").alias("predicted_mcs")
    )


def exponents(n_features: int, degree: int) -> list[tuple[int, ...]]:
    """Exponent tuples up to ``degree`` in graded order, constant first."""
    out = []
    for d in range(degree + 1):
        for picks in combinations_with_replacement(range(n_features), d):
            out.append(tuple(picks.count(i) for i in range(n_features)))
    return out


def _unscale(terms, centers, widths) -> dict[tuple[int, ...], float]:
    """Coefficients in the original variables of a polynomial in (x - center) / width."""
    total: dict[tuple[int, ...], float] = {}
    for powers, coefficient in terms.items():
        partial = {(): coefficient}
        for power, center, width in zip(powers, centers, widths):
            factor = np.poly1d([1 / width, -center / width]) ** power if power else np.poly1d([1.0])
            spread = factor.coeffs[::-1]
            partial = {k + (i,): v * c for k, v in partial.items() for i, c in enumerate(spread)}
        for k, v in partial.items():
            total[k] = total.get(k, 0.0) + v
    return total


# Factors that the driver reduces by itself; more are first reduced by tasks. A degree gives ever more terms.
FACTORS = 256


def _reduced(factors) -> np.ndarray:
    """Upper triangular factor of matrices laid on top of each other; their orthogonal factors are of no use."""
    return np.linalg.qr(np.vstack(list(factors)), mode="r")


def triangular_factor(rows: DataFrame, build: Callable[[list[np.ndarray]], np.ndarray], width: int) -> np.ndarray:
    """R of the QR factorization of a tall matrix, ``build`` making its rows from the columns of a batch.

    Each task reduces its rows to one small factor, batch by batch, and the factors are reduced like rows. R has the
    condition of the matrix, not its square as a table of moments has.
    """

    def emit(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = build([batch.column(i).to_numpy() for i in range(batch.num_columns)])
                held = _reduced([part] if held is None else [held, part])
        yield from emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            parts = [np.array(r).reshape(-1, width) for r in batch.column(0).to_pylist()]
            if parts:
                held = _reduced(parts if held is None else [held, *parts])
        yield from emit(held)

    factors, parts = rows.mapInArrow(factor, "r array<double>"), rows.rdd.getNumPartitions()
    while parts > FACTORS:
        parts = -(-parts // FACTORS)
        factors = factors.repartition(parts).mapInArrow(merge, "r array<double>")
    found = [np.array(r["r"]).reshape(-1, width) for r in factors.collect()]
    return _reduced(found) if found else np.zeros((0, width))


@dataclass(frozen=True)
class PolynomialFit:
    """Least-squares polynomial in variables scaled to [-1, 1]: ``scaled`` maps exponents to coefficients."""

    features: tuple[str, ...]
    centers: tuple[float, ...]
    widths: tuple[float, ...]
    scaled: dict[tuple[int, ...], float]

    def terms(self) -> dict[tuple[int, ...], float]:
        """Coefficients in the original variables."""
        return _unscale(self.scaled, self.centers, self.widths)

    def column(self) -> Column:
        """Value of the polynomial, computed in the scaled variables, where nothing cancels."""
        z = [(F.col(f) - F.lit(c)) / F.lit(w) for f, c, w in zip(self.features, self.centers, self.widths)]
        total = F.lit(0.0)
        for powers, coefficient in self.scaled.items():
            factors = [v for v, power in zip(z, powers) for _ in range(power)]
            total = total + reduce(lambda acc, v: acc * v, factors, F.lit(float(coefficient)))
        return total


def polynomial_fit(df: DataFrame, features, target: str, degree: int) -> PolynomialFit:
    """Least squares by a tall-skinny QR factorization: one pass for the ranges, one for the factor.

    Rows with a missing value take no part. Where the data do not determine all terms (few different values), the
    smallest coefficients that fit best are taken; no rows give zeros.
    """
    features = list(features)
    rows = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y")).dropna()
    ranges = rows.agg(*[g(f"x{i}") for i in range(len(features)) for g in (F.min, F.max)]).first()
    centers = tuple(((ranges[2 * i] or 0.0) + (ranges[2 * i + 1] or 0.0)) / 2 for i in range(len(features)))
    widths = tuple((((ranges[2 * i + 1] or 0.0) - (ranges[2 * i] or 0.0)) / 2) or 1.0 for i in range(len(features)))
    terms = exponents(len(features), degree)

    def build(columns: list[np.ndarray]) -> np.ndarray:
        z = [(x - c) / w for x, c, w in zip(columns, centers, widths)]
        products = [reduce(np.multiply, [v ** p for v, p in zip(z, powers)]) for powers in terms]
        return np.stack([*products, columns[-1]], axis=1)

    r = triangular_factor(rows, build, len(terms) + 1)
    solution = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0] if len(r) else np.zeros(len(terms))
    return PolynomialFit(tuple(features), centers, widths, dict(zip(terms, solution.tolist())))


def fit_polynomial(df: DataFrame, features, target: str, degree: int) -> dict[tuple[int, ...], float]:
    """Coefficients of :func:`polynomial_fit` in the original variables, keyed by exponents."""
    return polynomial_fit(df, features, target, degree).terms()


def polynomial_formula(terms, features) -> str:
    pieces = []
    for powers, coefficient in terms.items():
        if abs(coefficient) < 1e-12:
            continue
        name = " ".join(f if p == 1 else f"{f}^{p}" for f, p in zip(features, powers) if p)
        pieces.append(f"({coefficient:.6f})*{name}" if name else f"{coefficient:.6f}")
    return " + ".join(pieces)


def fit_quality(df: DataFrame, target: str, prediction: Column) -> DataFrame:
    """R2, RMSE and MAE of a prediction column."""
    rows = df.select(F.col(target).cast("double").alias("y"), prediction.alias("f")).dropna()
    sse = F.sum((F.col("y") - F.col("f")) ** 2)
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("rows"), (1 - sse / (n * F.var_pop("y"))).alias("r2"), F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(F.col("y") - F.col("f"))).alias("mae"),
    )


# --- pass probability ------------------------------------------------------------------------------

def balance_weights(df: DataFrame, label: str = "label_pass", out: str = "weight") -> DataFrame:
    """Weight of passing rows = failures / passes; failures weigh 1."""
    totals = df.agg(F.sum((F.col(label) >= 0.5).cast("bigint")).alias("_pos"), F.sum((F.col(label) < 0.5).cast("bigint")).alias("_neg"))
    ratio = F.when(F.col("_pos") > 0, F.col("_neg") / F.col("_pos")).otherwise(1.0)
    return df.join(F.broadcast(totals)).withColumn(out, F.when(F.col(label) >= 0.5, ratio).otherwise(1.0)).drop("_pos", "_neg")


def with_features(df: DataFrame, features) -> DataFrame:
    """Model inputs in model order; a feature the frame lacks is 0."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features})


def train_pass_model(df: DataFrame, features, key, label: str = "label_pass", kind: str = "gbt", depth: int = 8,
                     rounds: int = 100, rate: float = 0.05, subsample: float = 0.8, bins: int = 256,
                     validation: float = 0.2, balance: bool = False, seed: int = 42, tolerance: float = 1e-6) -> PipelineModel:
    """P(pass | context, MCS): boosted trees with early stopping on a hashed validation share, or logistic regression
    down to ``tolerance``."""
    rows = with_features(df, features).withColumn("_label", F.col(label).cast("double"))
    rows = rows.withColumn("_valid", hash_fraction(key, seed + 1) < validation)
    if balance:
        rows = balance_weights(rows, "_label", "_weight")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    if kind == "gbt":
        model = GBTClassifier(
            featuresCol="_features", labelCol="_label", maxDepth=depth, maxIter=rounds, stepSize=rate,
            subsamplingRate=subsample, maxBins=bins, validationIndicatorCol="_valid", seed=seed, predictionCol="_prediction",
        ).setRawPredictionCol("_raw").setProbabilityCol("_probability")
    else:
        model = LogisticRegression(featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", tol=tolerance,
                                   probabilityCol="_probability", predictionCol="_prediction")
    if balance:
        model = model.setWeightCol("_weight")
    return Pipeline(stages=[assembler, model]).fit(rows)


def score(model: PipelineModel, df: DataFrame, features, out: str = "p") -> DataFrame:
    """Pass probability of every row; original columns are kept as they are."""
    wanted = list(df.columns)
    prepared = df.select("*", *[
        (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in wanted else F.lit(0.0)).alias(f"_in_{f}") for f in features
    ])
    assembler = VectorAssembler(inputCols=[f"_in_{f}" for f in features], outputCol="_features")
    scored = model.stages[-1].transform(assembler.transform(prepared))
    return scored.select(*wanted, F.element_at(vector_to_array("_probability"), 2).alias(out))


def scorer(model: PipelineModel, features):
    """Row scorer for :func:`linkops.operators.candidates.score_contexts`."""
    return lambda df: score(model, df, features)


def monotone_probability(cand: str = "cand") -> Column:
    """Candidates whose probability never rises with MCS: each keeps the least probability up to it."""
    return F.arrow_udf(_lowered, "array<struct<mcs:int,p:double,eff:double>>")(F.col(cand))


def _lowered(cand: pa.Array) -> pa.Array:
    p, inside = matrix(cand, "p")
    if inside.size:
        # Nulls and NaN lower nothing; before the first number the least probability is infinite.
        p = np.fmin.accumulate(np.fmin(p, np.inf), axis=1)
    return rebuilt(cand, p[inside], np.zeros(int(inside.sum()), bool))


# --- classifiers -----------------------------------------------------------------------------------

def train_classifier(df: DataFrame, features, label: str, trees: int = 100, depth: int = 5, seed: int = 42,
                     kind: str = "forest") -> PipelineModel:
    """Class model on any label column; labels are indexed in sorted order and decoded on output."""
    indexer = StringIndexer(inputCol="_text", outputCol="_label", stringOrderType="alphabetAsc")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    rows = df.withColumn("_text", F.col(label).cast("string"))
    shared = dict(featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                  probabilityCol="_probability", rawPredictionCol="_raw")
    if kind == "forest":
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **shared)
    else:
        model = LogisticRegression(**shared)
    labels = indexer.fit(rows)
    decode = IndexToString(inputCol="_prediction", outputCol="_decoded", labels=labels.labels)
    return Pipeline(stages=[labels, assembler, model, decode]).fit(rows)


def classify(model: PipelineModel, df: DataFrame, out: str = "predicted", kind: str = "int",
             ranked: str | None = None, probability: str | None = None) -> DataFrame:
    """Predicted class; optionally all classes best first, and the probability array in label order."""
    labels = model.stages[0].labels
    frame = df
    for stage in model.stages[1:]:
        frame = stage.transform(frame)
    scored = frame.withColumn("_pa", vector_to_array("_probability"))
    columns = [F.col(c) for c in df.columns] + [F.col("_decoded").cast(kind).alias(out)]
    if ranked:
        entries = F.transform("_pa", lambda x, i: F.struct((-x).alias("m"), i.alias("i")))
        names = F.array(*[F.lit(v).cast(kind) for v in labels])
        columns.append(F.transform(F.array_sort(entries), lambda e: F.element_at(names, e["i"] + 1)).alias(ranked))
    if probability:
        columns.append(F.col("_pa").alias(probability))
    return scored.select(*columns)


def feature_importance(model: PipelineModel, features) -> list[tuple[str, float, int]]:
    """``(feature, gain share, split count)`` of a tree model, best first. Size is that of the model."""
    stage = next(s for s in model.stages if hasattr(s, "featureImportances"))
    gains = stage.featureImportances.toArray()
    splits = [0] * len(features)
    for index in re.findall(r"If \(feature (\d+)", stage.toDebugString):
        splits[int(index)] += 1
    rows = [(f, float(g), s) for f, g, s in zip(features, gains, splits)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def node_table(spark: SparkSession, model: PipelineModel, path: str) -> DataFrame:
    """``tree, feature, gain, weight`` of every split of a tree model stored at ``path``: index of the feature, gain and
    weight of the rows that came to the node."""
    stage = next(s for s in model.stages if hasattr(s, "featureImportances"))
    nodes = spark.read.parquet(f"{path}/stages/*_{stage.uid}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats = F.col("impurityStats")
    # Boosted trees fit values and keep count, sum and squares; forests of classes keep the weight of each class.
    weight = stats[0] if not _is_forest(stage) else F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    return nodes.where(F.col("split.featureIndex") >= 0).select("tree", F.col("split.featureIndex").alias("feature"), "gain", weight.alias("weight"))


def _is_forest(stage) -> bool:
    return isinstance(stage, RandomForestClassificationModel)


def split_importance(spark: SparkSession, model: PipelineModel, path: str, features) -> DataFrame:
    """``feature, gain, splits`` of a stored tree model: share of the gain, weighted by rows, and number of splits.

    In a forest every tree counts alike, in boosted trees every split by its own weight. Features without a split have
    zeros.
    """
    stage = next(s for s in model.stages if hasattr(s, "featureImportances"))
    gained = node_table(spark, model, path).groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("weight")).alias("g"), F.count(F.lit(1)).alias("n"),
    )
    if _is_forest(stage):
        whole = gained.groupBy("tree").agg(F.sum("g").alias("all"))
        gained = gained.join(whole, "tree").withColumn("g", F.when(F.col("all") > 0, F.col("g") / F.col("all")).otherwise(0.0))
    by_feature = gained.groupBy("feature").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    total = by_feature.agg(F.sum("g").alias("total"))
    names = spark.createDataFrame(list(enumerate(features)), "feature int, name string")  # a row for each feature
    share = F.when(F.col("total") > 0, F.coalesce("g", F.lit(0.0)) / F.col("total")).otherwise(0.0)
    return names.join(by_feature, "feature", "left").join(F.broadcast(total)).select(
        F.col("name").alias("feature"), share.alias("gain"), F.coalesce("n", F.lit(0)).alias("splits"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
