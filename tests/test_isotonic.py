"""Monotone fits against a plain pool-adjacent-violators loop and against the conditions of a least-squares fit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkops.operators.isotonic import isotonic_fit, isotonic_grid, pool


def brute(points, increasing=True):
    """Fit of ``x -> (weight, weighted sum)`` by one loop with a stack."""
    sign, blocks = 1 if increasing else -1, []
    for x in sorted(points):
        w, s = points[x]
        blocks.append([w, sign * s, [x]])
        while len(blocks) > 1 and blocks[-1][1] / blocks[-1][0] < blocks[-2][1] / blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {x: sign * s / w for w, s, xs in blocks for x in xs}


def merged(rows):
    points = {}
    for series, x, y, w in rows:
        if x is not None and y is not None and np.isfinite(y) and w is not None and w > 0:
            held = points.setdefault(series, {}).setdefault(x, [0.0, 0.0])
            held[0] += w
            held[1] += w * y
    return points


SHAPES = {
    "noise": lambda i, pick: pick.gauss(0, 1),
    "rising": lambda i, pick: float(i),
    "falling": lambda i, pick: -float(i),
    "trend": lambda i, pick: i / 100 + pick.gauss(0, 1),
    "saw": lambda i, pick: float(i % 97),
    "late fall": lambda i, pick: float(i) if i < 700 else -300.0,
    "steps": lambda i, pick: float(i // 50 + (i % 50 == 7) * 9),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("increasing", [True, False])
def test_fit_equals_a_plain_loop(spark, shape, increasing):
    pick = random.Random(shape)
    rows = [("long" if i < 740 else None if i < 780 else "short", i, SHAPES[shape](i, pick), pick.choice([0.5, 1.0, 3.0])) for i in range(800)]
    rows += [("long", 5, 2.0, 1.0), ("long", None, 1.0, 1.0), ("long", 9, None, 1.0), ("long", 9, float("nan"), 1.0), ("long", 9, 1e9, 0.0), ("one", 1, 4.0, 2.0)]
    df = spark.createDataFrame(rows, "s string, x int, y double, w double")
    got = {(r["s"], r["x"]): r["fit"] for r in isotonic_fit(df, ["s"], "x", "y", F.col("w"), increasing).collect()}
    want = {(s, x): f for s, own in merged(rows).items() for x, f in brute(own, increasing).items()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_fit_of_one_series_without_keys_and_of_nothing(spark):
    rows = [(i, float((i * 37) % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "x int, y double")
    want = brute({x: (1.0, y) for x, y in rows})
    assert {r["x"]: r["fit"] for r in isotonic_fit(df, [], "x", "y").collect()} == pytest.approx(want)
    assert isotonic_fit(df.where("false"), [], "x", "y").collect() == []


def test_a_fall_that_eats_its_way_back_is_pooled():
    values = np.append(np.arange(5_000.0), -1e9)
    first, w, s = pool(np.arange(5_001) == 0, np.ones(5_001), values.copy())
    assert first.tolist() == [0] and w[0] == 5_001 and s[0] == values.sum()


def test_grid_is_monotone_and_nothing_nearer_is(spark):
    """The fit is the nearest one if moving towards any other monotone table makes it worse."""
    pick, rows = random.Random(9), []
    for x in range(9):
        for z in range(7):
            if pick.random() < 0.85:
                rows.append((x, z, x * 0.3 - z * 0.2 + pick.gauss(0, 1), pick.choice([1.0, 2.0, 5.0])))
    rows += [(None, 1, 1.0, 1.0), (1, 1, None, 1.0), (1, 2, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "x int, z int, y double, w double")
    got = {(r["x"], r["z"]): r["fit"] for r in isotonic_grid(df, "x", "z", "y", F.col("w"), (True, False), 1e-7).collect()}
    data = {(x, z): (y, w) for x, z, y, w in rows if x is not None and y is not None and w > 0}
    assert got.keys() == data.keys()
    cells = sorted(got)
    for a in cells:
        for b in cells:
            if a[1] == b[1] and a[0] < b[0]:
                assert got[a] <= got[b] + 1e-5
            if a[0] == b[0] and a[1] < b[1]:
                assert got[a] >= got[b] - 1e-5
    # Monotone tables are sums of steps over upper sets and a constant; the residual must not point along any of them.
    residual = {c: data[c][1] * (data[c][0] - got[c]) for c in cells}
    assert abs(sum(residual.values())) < 1e-4
    assert abs(sum(residual[c] * got[c] for c in cells)) < 1e-4
    for _ in range(300):
        # A random upper set: from a least x on, which does not fall as z grows.
        edges = np.maximum.accumulate([pick.randrange(0, 10) for _ in range(7)])
        assert sum(residual[x, z] for x, z in cells if x >= edges[z]) <= 1e-4
