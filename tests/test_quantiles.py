"""Exact quantiles against sorting, on values that are hard to cut into bins."""

import math
import random

import pytest

from linkops.operators import quantiles
from linkops.operators.quantiles import grouped_quantiles

NAN, INF = float("nan"), float("inf")
QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def brute(values, q, method):
    x = sorted(v + 0.0 for v in values if v is not None and not math.isnan(v))
    n = len(x)
    pos = {"nearest": lambda: float(math.floor((n - 1) * q + 0.5)), "linear": lambda: (n - 1) * q, "midpoint": lambda: min(max(n * q - 0.5, 0.0), n - 1)}[method]()
    a, b = x[math.floor(pos)], x[math.ceil(pos)]
    return a if a == b or pos == math.floor(pos) else a + (pos - math.floor(pos)) * (b - a)


def groups():
    pick = random.Random(1)
    out = {
        "uniform": [pick.random() for _ in range(3000)],
        "one": [4.25],
        "copies": [7.0] * 500 + [pick.random() for _ in range(20)],
        "decades": [pick.choice([-1, 1]) * 10.0 ** pick.uniform(-320, 308) for _ in range(800)],
        "neighbours": [1.0 + i * 2.0 ** -52 for i in range(400)],
        "ends": [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1e-300] * 9,
        "infinite": [float("inf")] * 40 + [float("-inf")] * 40 + [1.5, 2.5, 1.7e308],
        "outlier": [pick.gauss(0, 1) for _ in range(900)] + [1e200, -1e250],
        "least": [k * 5e-324 for k in range(1, 90)],
        None: [1.0, 2.0, None, float("nan"), 4.0],
        "nothing": [None, float("nan")],
    }
    return out


@pytest.mark.parametrize("method", ["linear", "nearest", "midpoint"])
def test_quantiles_of_groups(spark, method):
    rows = [(g, v) for g, values in groups().items() for v in values]
    random.Random(2).shuffle(rows)
    got = {(r["g"], r["q"]): r["v"] for r in grouped_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", QS, method).collect()}
    want = {(g, q): brute(values, q, method) for g, values in groups().items() if g != "nothing" for q in QS}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-15), (k, got[k], want[k])


def test_quantiles_without_keys_and_of_nothing(spark):
    values = [(random.Random(i).gauss(0, 1e6),) for i in range(2000)]
    df = spark.createDataFrame(values, "v double")
    got = {r["q"]: r["v"] for r in grouped_quantiles(df, [], "v", QS, "nearest").collect()}
    assert got == {q: brute([v for v, in values], q, "nearest") for q in QS}
    assert grouped_quantiles(df.where("false"), [], "v", QS).collect() == []


def test_whole_numbers(spark):
    df = spark.range(1, 10_001).selectExpr("id % 3 AS g", "id")
    got = {(r["g"], r["q"]): r["id"] for r in grouped_quantiles(df, ["g"], "id", [0.5, 0.999], "nearest").collect()}
    assert got == {(g, q): brute([float(i) for i in range(1, 10_001) if i % 3 == g], q, "nearest") for g in range(3) for q in (0.5, 0.999)}


def test_quantiles_of_values_in_arrays(spark, monkeypatch):
    """Arrays inside rows give what their values give in rows of their own, also when tasks and tables hold little."""
    from pyspark.sql import functions as F

    pick, rows = random.Random(7), []
    for i in range(3_000):
        cell = pick.choice([(1, 2), (1, -3), (9, 2), (None, 2)])
        cand = [(m, pick.choice([None, NAN, 0.0, -0.0, INF, -INF, pick.gauss(m or 0, 3), 10 ** pick.uniform(-200, 200)])) for m in (0, 5, 27, None)]
        rows.append((*cell, pick.choice([cand, cand[:2], [], None])))
    df = spark.createDataFrame(rows, "a long, b int, cand array<struct<m:int,p:double>>").repartition(3)
    plain = df.where("a IS NOT NULL").select("a", "b", F.inline("cand"))

    def found(source):
        return {(r["a"], r["b"], r["m"], r["q"]): r["p"] for r in quantiles.grouped_quantiles(source, ["a", "b", "m"], "p", QS).collect()}

    want = found(plain)
    assert len(want) == 3 * 4 * len(QS)
    for held, most in ((2_000_000, 500_000), (500, 500_000), (500, 2)):
        monkeypatch.setattr(quantiles, "HELD_VALUES", held)
        monkeypatch.setattr(quantiles, "BROADCAST_ROWS", most)
        got = found(quantiles.ArrayValues(df, ["a", "b"], "cand", "m", "p"))
        assert got.keys() == want.keys()
        assert all(got[k] == want[k] or (math.isnan(got[k]) and math.isnan(want[k])) for k in want)
