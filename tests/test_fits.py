"""Least-squares fits against numpy, on data where a table of moments would fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkops.operators import modelling


def frame(spark, x, y):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"f{i} double" for i in range(x.shape[1])) + ", y double")


def design(x, degree):
    low, high = x.min(axis=0), x.max(axis=0)
    width = np.where(high > low, (high - low) / 2, 1.0)
    z = (x - (low + high) / 2) / width
    return np.stack([np.prod(z ** np.array(e), axis=1) for e in modelling.exponents(x.shape[1], degree)], axis=1)


@pytest.mark.parametrize("case", ["three axes", "far from zero", "nearly dependent", "few values"])
def test_fit_agrees_with_lstsq(spark, case):
    pick = np.random.default_rng(3)
    x = pick.uniform(-1, 1, (900, 3)) * [10, 1e-3, 400]
    if case == "far from zero":
        x += [1e6, 5, -1e5]
    if case == "nearly dependent":
        x[:, 1] = x[:, 0] / 1e4 + 1e-5 * pick.standard_normal(900)
    if case == "few values":  # two different values do not determine a cubic
        x[:, 2] = np.where(x[:, 2] > 0, 1.0, 2.0)
    y = x[:, 0] - 3 * x[:, 1] * x[:, 2] + pick.standard_normal(900)
    df = frame(spark, x, y).repartition(6)
    fit = modelling.polynomial_fit(df, ["f0", "f1", "f2"], "y", 3)
    got = np.array([r["v"] for r in df.select("f0", "f1", "f2", fit.column().alias("v")).orderBy("f0").collect()])
    a = design(x, 3)
    want = (a @ np.linalg.lstsq(a, y, rcond=None)[0])[np.argsort(x[:, 0])]
    assert np.abs(got - want).max() < 1e-9 * np.abs(want).max()


def test_factors_are_reduced_by_tasks_first(spark, monkeypatch):
    monkeypatch.setattr(modelling, "FACTORS", 2)
    pick = np.random.default_rng(4)
    x = pick.standard_normal((300, 4))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(9)
    r = modelling.triangular_factor(rows, lambda columns: np.stack(columns, axis=1), 4)
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-12) and np.allclose(r, np.triu(r))


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 9.0), (4.0, None)], "x double, y double")
    fit = modelling.fit_polynomial(df, ["x"], "y", 1)
    assert fit[(1,)] == pytest.approx(2.0) and fit[(0,)] == pytest.approx(0.0, abs=1e-12)
    assert set(modelling.fit_polynomial(df.where("false"), ["x"], "y", 2).values()) == {0.0}
    assert df.where(F.col("x") == 1).transform(lambda d: d.select(modelling.polynomial_fit(d, ["x"], "y", 2).column().alias("v"))).first()["v"] == pytest.approx(2.0)


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_importance_from_the_stored_nodes(spark, tmp_path, kind):
    """Gain as the model itself gives it, splits as its text shows them, and both as SQL over the stored table has them."""
    import duckdb

    df = spark.range(900).selectExpr("id", "id % 7 AS a", "id % 11 AS b", "0 AS c", "CAST((id % 7 > 3) != (id % 11 > 4) AS INT) AS label_pass")
    if kind == "gbt":
        model = modelling.train_pass_model(df, ["a", "b", "c"], ["id"], rounds=4, depth=3)
    else:
        model = modelling.train_classifier(df, ["a", "b", "c"], "label_pass", trees=5, depth=3)
    path = f"{tmp_path}/model"
    modelling.save_model(model, path)
    got = {r["feature"]: (r["gain"], r["splits"]) for r in modelling.split_importance(spark, model, path, ["a", "b", "c"]).collect()}
    want = {f: (g, s) for f, g, s in modelling.feature_importance(model, ["a", "b", "c"])}
    assert got.keys() == want.keys() and got["c"] == (0.0, 0)
    assert all(got[f][1] == want[f][1] and got[f][0] == pytest.approx(want[f][0], rel=1e-12) for f in want)
    stage = "1" if kind == "gbt" else "2"
    counted = duckdb.sql(
        f"SELECT nodeData.split.featureIndex, count(*) FROM '{path}/stages/{stage}_*/data/*.parquet' WHERE nodeData.split.featureIndex >= 0 GROUP BY 1"
    ).fetchall()
    assert {"abc"[f]: n for f, n in counted} == {f: s for f, (_, s) in got.items() if s}


def test_pass_model_is_fitted_on_all_training_rows(spark, tmp_path):
    """Roots of the trees behind ``M4_monotone_scores`` hold the boosting's own share (0.8) of all rows they may learn from."""
    from linkops.catalog import models, registered
    from linkops.functions.expr import hash_fraction

    rows = spark.range(40_000).selectExpr(
        "id AS l_orderkey", "id * 13 % 997 AS l_partkey", "id % 100 AS l_suppkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber",
        "CAST(id * 31 % 50 + 1 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", "0.1D AS l_discount", "0.1D AS l_tax",
        "'A' AS l_returnflag", "TIMESTAMP '2024-01-01' AS l_shipdate",
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    counted = registered()["M4_monotone_scores"](spark, str(tmp_path)).collect()
    assert sum(r["count"] for r in counted) == 40_000
    learnt = models._rows(spark, str(tmp_path)).where("split = 'train'").where(hash_fraction(models.ROW_KEY, 43) >= 0.2).count()
    assert learnt > models.TRAINING_ROWS
    (path,) = [path for key, path in models._FITTED.items() if str(tmp_path) in key]  # the one model that the query fitted
    nodes = modelling.node_table(spark, modelling.load_model(path), path)
    roots = [r["w"] for r in nodes.groupBy("tree").agg(F.max("weight").alias("w")).collect()]
    assert roots and all(0.78 * learnt < w < 0.82 * learnt for w in roots)
