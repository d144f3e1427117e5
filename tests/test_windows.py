"""Trailing means and nearest rows against plain loops, with blocks and cells far smaller than the data."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from linkops.functions.expr import linspace
from linkops.operators import lut, ordered


def exact_mean(values):
    """Mean of what is there: exact for finite values, else as IEEE adds."""
    values = [v for v in values if v is not None]
    if not values:
        return None
    if all(math.isfinite(v) for v in values):
        return float(sum(map(Fraction, values)) / len(values))
    return sum(values) / len(values)


def close(a, b, scale):
    if a is None or b is None or not math.isfinite(b):
        return a is b or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))
    return abs(a - b) <= 4e-16 * max(abs(b), scale * 1e-9)


@pytest.mark.parametrize("odd", [False, True])
def test_trailing_means_in_small_blocks(spark, odd):
    pick, rows = random.Random(1), []
    for i in range(900):
        double = pick.choice([pick.uniform(-1, 1), 1e9 * pick.random(), 1e-7, None if i % 7 == 0 else 3.0])
        if odd and i % 97 == 5:
            double = pick.choice([float("nan"), float("inf"), float("-inf")])
        rows.append((i % 3 if i > 450 else 0, i, pick.randrange(10 ** 12), None if i % 11 == 0 else i % 5, double))
    df = spark.createDataFrame(rows, "s int, i int, a long, b int, c double")
    lags = {f"{c}_{lag}": (c, lag) for c in "abc" for lag in (1, 7, 100, 2000)}
    for start in (0, 3):
        got = {r["i"]: r for r in ordered.trailing(df, ["s"], ["i"], lags, start, block_rows=64).collect()}
        assert len(got) == len(rows)
        for s in (0, 1, 2):
            own = [r for r in rows if r[0] == s]
            for at, row in enumerate(own):
                for name, (c, lag) in lags.items():
                    frame = own[max(0, at - start - lag + 1):max(0, at - start + 1)]
                    want = exact_mean([r[2 + "abc".index(c)] for r in frame])
                    have = got[row[1]][name]
                    assert have == want if c != "c" else close(have, want, 1e9), (start, name, row, have, want)


def test_trailing_sums_beyond_64_bits(spark):
    rows = [(i, (1 << 61) + i) for i in range(40)]
    got = {r["i"]: r["m"] for r in ordered.trailing(spark.createDataFrame(rows, "i int, v long"), [], ["i"], {"m": ("v", 30)}).collect()}
    assert all(math.isclose(got[i], exact_mean([v for _, v in rows[max(0, i - 29):i + 1]]), rel_tol=1e-15) for i, _ in rows)


@pytest.mark.parametrize("compat", [False, True])
def test_windowed_error_rate(spark, compat):
    pick = random.Random(2)
    rows = [(i % 2, i, int(pick.random() < 0.3)) for i in range(300)]
    df = spark.createDataFrame(rows, "s int, i int, e int")
    got = {r["i"]: r["bler_window"] for r in ordered.windowed_error_rate(df, ["s"], ["i"], 16, F.col("e") == 1, compat).collect()}
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        for at, (_, i, _) in enumerate(own):
            last = [e for _, _, e in own[max(0, at - 16):at]]
            want = sum(last) / len(last) if last else None
            if compat and at > 16:
                want = sum(e for _, _, e in own[at - 17:at]) / 16
            assert got[i] == want


def test_empty_series(spark):
    df = spark.createDataFrame([], "s int, i int, v double")
    assert ordered.trailing(df, ["s"], ["i"], {"m": ("v", 5)}).collect() == []


def brute_nearest(rows, points, scales, k):
    out = {}
    for v, at in enumerate(points):
        near = []
        for key, target, *x in rows:
            if target is None or any(c is None for c in x):
                continue
            near.append((math.sqrt(sum(((c - p) / s) ** 2 for c, p, s in zip(x, at, scales))), key, target))
        near = sorted(near)[:k]
        if near:
            out[v] = (sum(t / (d + 1e-6) for d, _, t in near) / sum(1 / (d + 1e-6) for d, _, _ in near), len(near))
    return out


@pytest.mark.parametrize("cells,k,kind", [(1, 5, "spread"), (64, 5, "spread"), (4096, 30, "spread"), (4096, 40, "ties"), (4096, 900, "spread"), (256, 7, "far")])
def test_nearest_rows_equal_brute_force(spark, cells, k, kind):
    pick, rows = random.Random(cells + k), []
    for i in range(600):
        if kind == "ties":
            x = [float(pick.randrange(4)), float(pick.randrange(3))]
        elif kind == "far":  # most rows outside the axes
            x = [pick.gauss(0, 50), pick.gauss(5, 30)]
        else:
            x = [pick.uniform(-3, 3), pick.choice([pick.uniform(0, 1), 0.5])]
        rows.append((i, pick.randrange(28), *x))
    rows += [(1000, None, 0.0, 0.0), (1001, 5, None, 0.0), (1002, 3, 0.0, None)]
    axes, scales = {"x": linspace(-3.0, 3.0, 4), "y": linspace(0.0, 2.0, 3)}, [6.0, 2.0]
    df = spark.createDataFrame(rows, "key int, t int, x double, y double")
    want = brute_nearest(rows, [p for _, p in lut.grid_vertices(axes)], scales, k)
    got = {r["vertex"]: (r["value"], r["neighbours"]) for r in lut.nearest_rows(df, ["x", "y"], "t", axes, scales, ["key"], k, cells).collect()}
    assert got.keys() == want.keys()
    assert all(got[v][1] == want[v][1] and got[v][0] == pytest.approx(want[v][0], rel=1e-9) for v in want)
    assert lut.nearest_rows(df.where("false"), ["x", "y"], "t", axes, scales, ["key"], k).collect() == []


def test_nearest_rows_look_at_few_cells(spark):
    """With ten thousand rows and 25 vertices only the cells around the vertices are asked for."""
    df = spark.range(10_000).select(F.col("id").alias("key"), (F.rand(1) * 4).alias("x"), (F.rand(2) * 2).alias("y"), (F.col("id") % 28).alias("t"))
    axes = {"x": linspace(0.0, 4.0, 5), "y": linspace(0.0, 2.0, 5)}
    points, scales = [p for _, p in lut.grid_vertices(axes)], [4.0, 2.0]
    index = [F.floor(F.col(c) / s * 50).cast("int").alias(f"_cell{i}") for i, (c, s) in enumerate(zip("xy", scales))]
    rows = df.select("key", "x", "y", "t", *index).cache()
    cells = lut.nearest_cells(rows, ["x", "y"], ["_cell0", "_cell1"], points, scales, 20)
    looked_at = rows.join(cells, ["_cell0", "_cell1"]).count()
    assert 25 * 20 <= looked_at <= 25 * 20 * 8  # not 250,000


def test_short_series_are_blocks_as_they_are(spark):
    """The same means whether series are cut into blocks or not, and without a series."""
    pick = random.Random(7)
    rows = [(i % 4, i, pick.choice([None, pick.uniform(-5, 5), float("nan") if i % 50 == 3 else 1.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "s int, i int, v double")
    lags = {"a": ("v", 3), "b": ("v", 60)}
    for series in (["s"], []):
        whole, cut = ({r["i"]: (r["a"], r["b"]) for r in ordered.trailing(df, series, ["i"], lags, 1, block_rows=n).collect()} for n in (1_000, 32))
        assert whole.keys() == cut.keys()
        assert all(close(x, y, 5) if x is not None and y is not None else x is y for i in whole for x, y in zip(whole[i], cut[i]))
