"""Choices over candidate arrays in Arrow batches against the folds they stand for."""

import math

from pyspark.sql import functions as F

from linkops.functions.expr import round_share
from linkops.operators import candidates, modelling, policy, replay

NAN, INF = float("nan"), float("inf")
SCHEMA = "id int, limit double, cand array<struct<mcs:int,p:double,eff:double>>"
ROWS = [
    [0.9, 0.8, 0.1], [0.1, 0.9, 0.9], [0.5, 0.5], [None, 0.9], [0.2, None, 0.7], [NAN, 0.5], [0.5, NAN, NAN, 0.1],
    [0.0, 0.0], [-INF, None], [INF, NAN], [], None, [1.0],
]


def frame(spark, rows=ROWS):
    limits = [0.5, 0.9, None, 0.9, 0.2, 0.5, NAN]
    packed = [(i, limits[i % 7], None if r is None else [(m, p, 0.5 + m) for m, p in enumerate(r)]) for i, r in enumerate(rows)]
    return spark.createDataFrame(packed, SCHEMA).coalesce(1)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_best_throughput_is_the_fold(spark):
    df = frame(spark).select(policy.throughput_choice().alias("a"), policy.best_throughput().alias("b"))
    for row in df.collect():
        assert (row["a"] is None or row["a"]["mcs"] is None) == (row["b"] is None)
        assert row["b"] is None or all(same(x, y) for x, y in zip(row["a"], row["b"]))


def test_best_throughput_without_any_candidate(spark):
    assert {r[0] for r in frame(spark, [[], None]).select(policy.best_throughput()).collect()} == {None}


def test_success_mask_is_the_fold(spark):
    fold = F.aggregate("cand", F.lit(0), lambda acc, x: acc + F.when(x["p"] >= F.col("limit"), F.call_function("shiftleft", F.lit(1), x["mcs"])).otherwise(0))
    rows = frame(spark).select(fold.alias("a"), replay.success_mask(F.col("limit")).alias("b")).collect()
    assert [r["b"] for r in rows] == [r["a"] for r in rows] and any(r["a"] for r in rows)


def test_monotone_probability_is_the_running_minimum(spark):
    for row in frame(spark).select("cand", modelling.monotone_probability().alias("b")).collect():
        if row["cand"] is None:
            assert row["b"] is None
            continue
        low, want = INF, []
        for x in row["cand"]:
            low = low if x["p"] is None or math.isnan(x["p"]) else min(low, x["p"])
            want.append((x["mcs"], low, x["eff"]))
        assert [tuple(x) for x in row["b"]] == want


def test_unrolled_candidates_are_the_lambda(spark):
    df = spark.sql("SELECT * FROM VALUES (-3.25D), (0D), (17.3D), (CAST('NaN' AS DOUBLE)), (NULL) t(snr)")
    p = lambda m: 1 / (1 + F.exp(-(0.6 * (F.col("snr") - (m * 0.9 - 9.0)))))
    both = candidates.candidates(candidates.candidates(df, p), p, out="b", unrolled=True)
    assert both.where(~F.col("cand").eqNullSafe(F.col("b"))).count() == 0


def test_round_share_is_round(spark):
    """Halves, values next to them, and odd ones, at a number of digits that makes them frequent."""
    halves = spark.range(2001).select(((F.col("id") + F.lit(0.5)) / 2001).alias("x"), (F.col("id") / 2000).alias("y"))
    values = halves.selectExpr("x AS v").union(halves.selectExpr("y AS v")).union(halves.selectExpr("y + 0.0005 AS v"))
    values = values.union(spark.sql("SELECT explode(array(0.0005D, 0.0015D, 0.9995D, 1D, 0D, -0.3D, 2.5D, CAST('NaN' AS DOUBLE), CAST('Infinity' AS DOUBLE), NULL)) AS v"))
    for digits in (3, 9):
        wrong = values.where(~F.round("v", digits).eqNullSafe(round_share(F.col("v"), digits)))
        assert wrong.count() == 0
