"""Embedding whitening against numpy's dense solver and exact integers."""

import math
import random

import numpy as np
import pytest

from linkops.llm.whitening import deviations, jacobi_davidson, minres, whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    """``(vec_id, x)`` of the rows that take part, and the covariance of the distinct x."""
    part = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in part})
    fit = np.array(distinct, float)
    centred = fit - fit.mean(axis=0)
    return part, distinct, centred.T @ centred / len(fit)


def check(got, rows, components=4):
    part, distinct, cov = brute(rows)
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    k = len(values)
    want = {}
    for i, x in part:
        want.setdefault(i, []).append((x, sum((n * c - s) ** 2 for c, s in zip(x, sums))))
    assert len(got) == k * len(part) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    for r in got:
        c = r["component"] - 1
        assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9) and r["identity_error"] < 1e-8
        plain = [abs((np.array(x) - np.array(sums) / n) @ vectors[:, c]) / math.sqrt(values[c]) for x, d in want[r["vec_id"]] if d == r["deviation"]]
        assert min(abs(p - abs(r["whitened"])) for p in plain) < 1e-7


def table(seed, n, dim):
    pick = np.random.default_rng(seed)
    mix = pick.standard_normal((dim, dim)) * (0.8 ** np.arange(dim))
    return [(i, [float(c) for c in pick.standard_normal(dim) @ mix.T]) for i in range(n)]


def test_whitening_equals_a_dense_solution(spark):
    rows = table(1, 300, 12)
    rows += [(1_000 + i, rows[4][1]) for i in range(150)] + [(4, rows[4][1]), (None, rows[5][1])]
    rows += [(2_000, None), (2_001, []), (2_002, [None] + [0.0] * 11), (2_003, [float("nan")] + [0.0] * 11), (2_004, [float("inf")] * 12), (2_005, [-0.0] * 12)]
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    check(got, rows)
    sign = {}
    for r in got:  # equal vectors have equal rows
        sign.setdefault((r["deviation"], r["component"]), set()).add(r["whitened"])
    assert all(len(s) == 1 for s in sign.values())


def test_few_dimensions_few_vectors_and_empty_tables(spark):
    two = [(i, [float(i), float(i * i % 7)]) for i in range(9)]
    check(whiten(spark.createDataFrame(two, SCHEMA)).collect(), two, 2)
    line = spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(5)], SCHEMA)
    assert {r["component"] for r in whiten(line).collect()} == {1}  # the other directions carry nothing
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], SCHEMA)
    empty = spark.createDataFrame([(3, None)], SCHEMA)
    assert whiten(one).collect() == [] and whiten(empty).collect() == [] and whiten(empty.where("false")).collect() == []


def test_extra_columns_and_other_names(spark):
    rows = table(2, 40, 5)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "1 AS n", "'a' AS x", "2 AS component", "3 AS block")
    check(whiten(wide).collect(), rows)
    assert whiten(wide.selectExpr("vec_id AS `my id`", "embedding AS v", "n"), "my id", "v", 2).columns[0] == "my id"


def test_vectors_of_different_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA).coalesce(1))
    with pytest.raises(Exception, match="different lengths"):  # met only after the shuffle
        whiten(spark.createDataFrame([(1, [1.0] * 2), (2, [1.0] * 4)], SCHEMA).repartition(2, "vec_id"))


def test_deviations_stay_exact_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    assert deviations(x, 1 << 30, [5, 7]) == [sum(((1 << 30) * v - s) ** 2 for v, s in zip(row, (5, 7))) for row in x.tolist()]


@pytest.mark.parametrize("values", [
    [3.0], [1, 1, 1], [4, 4, 1, 0, 0], [1] * 40, [1e6] + [1] * 40, [1, 0, 0, 0, 0, 0], list(np.linspace(1, 2, 90)), [0.5 ** k for k in range(50)],
    [2, 2, 2, 2, 2 - 1e-7] + [1] * 30,
])
def test_solver_on_known_spectra(values):
    pick = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(pick.standard_normal((len(values), len(values))))
    a = q * np.array(values, float) @ q.T
    a = (a + a.T) / 2
    got, vectors, _ = jacobi_davidson(lambda u: a @ u, len(values), 4)
    want = sorted(values, reverse=True)[:4]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12 * want[0])
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * want[0] and np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)


def test_minres_solves_several_systems_at_once():
    pick = random.Random(8)
    a = np.array([[pick.gauss(0, 1) for _ in range(20)] for _ in range(20)])
    a = a + a.T  # indefinite
    b = np.stack([np.ones(20), np.arange(20.0), np.zeros(20)], axis=1)
    x = minres(lambda t: a @ t, b, 60, np.full(3, 1e-13))
    assert np.abs(a @ x - b).max() < 1e-6 and not x[:, 2].any()
