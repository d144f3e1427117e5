"""Embedding whitening by a block Jacobi-Davidson method.

The covariance is never formed: all the solver asks for are products with a few vectors at once, each one pass over
the distinct vectors, centred before they are multiplied. The wanted pairs are improved together. Their correction
equations, projected against the pairs themselves and those already locked, are solved by a few MINRES steps in
lockstep, so one pass serves all of them; the solutions extend the subspace for the next Rayleigh-Ritz step. A pair is
locked when its residual is down to rounding. The driver holds a few vectors of the embedding's dimension, no data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import batch_rows, materialize

COMPONENTS = 4
SCALE = 256
# Vectors packed into one row of the fit list, and rows of vectors sent to Python at once.
PACK, ROWS = 2_048, 8_192
# Partial sums that the driver adds up by itself; more are first added by tasks.
PARTIALS = 256
# MINRES steps for one correction, width of the subspace at which it is cut back, and rounds before giving up.
INNER_STEPS, WIDEST, ROUNDS = 8, 48, 200
# A residual of so many roundings of the largest value is at double precision.
ROUNDINGS = 64


def whole(batch: pa.RecordBatch, at: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose vector takes part, and their entries ``floor(scale c)``, one row each.

    A vector takes part unless it is null, empty, or holds a null or non-finite entry; all others must have one length.
    """
    lists = batch.column(at)
    size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy())
    flat = lists.flatten()
    value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(value)  # nulls come as NaN
    ends = np.concatenate(([0], np.cumsum(bad)))
    stop = np.cumsum(size)
    good = np.nonzero((size > 0) & (ends[stop] == ends[stop - size]))[0]
    if not len(good):
        return good, np.empty((0, 0), np.int64)
    dim = int(size[good[0]])
    if (size[good] != dim).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(size[good].tolist()))}")
    places = (stop - size)[good][:, None] + np.arange(dim)
    return good, np.floor(scale * value[places]).astype(np.int64)


def fit_list(rows: DataFrame, column: str, scale: int = SCALE) -> DataFrame:
    """Stored ``block, n``: each distinct vector once, packed up to ``PACK`` vectors of little-endian longs a row."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole(batch, 0, scale)
            if len(x):
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<i8"))])
                yield pa.RecordBatch.from_arrays([flat.cast(pa.binary())], ["x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            held.extend(batch.column(0).to_pylist())
            if len({len(x) for x in held}) > 1:
                raise ValueError(f"vectors of different lengths: {sorted({len(x) // 8 for x in held})}")
            for start in range(0, len(held) - PACK + 1, PACK):
                yield pa.RecordBatch.from_pydict({"block": [b"".join(held[start:start + PACK])], "n": pa.array([PACK], pa.int64())})
            held = held[len(held) // PACK * PACK:]
        if held:
            yield pa.RecordBatch.from_pydict({"block": [b"".join(held)], "n": pa.array([len(held)], pa.int64())})

    with batch_rows(rows.sparkSession, ROWS):
        distinct = rows.select(column).mapInArrow(vectors, "x binary").distinct()
        return materialize(distinct.mapInArrow(packed, "block binary, n long"), "fit-list")


def _totals(fit: DataFrame, fn: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """Sum over the fit list of ``fn`` of each block of vectors, an array of one size; ``kind`` is its element type.

    Tasks add up their blocks; beyond ``PARTIALS`` tasks, further tasks add up their sums.
    """
    dtype = {"double": np.float64, "long": np.int64}[kind]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = fn(np.frombuffer(block, "<i8").reshape(n, -1)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for own in batch.column(0).to_pylist():
                own = np.array(own, dtype)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total]})

    sums, parts = fit.select("block", "n").mapInArrow(add, f"v array<{kind}>"), fit.rdd.getNumPartitions()
    while parts > PARTIALS:
        parts = -(-parts // PARTIALS)
        sums = sums.repartition(parts).mapInArrow(merge, f"v array<{kind}>")
    found = [np.array(r["v"], dtype) for r in sums.collect()]
    return np.sum(found, axis=0) if found else None


def minres(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tolerance: np.ndarray) -> np.ndarray:
    """MINRES for several symmetric systems in lockstep: ``product`` takes a matrix of one vector for each of them.

    Stops after ``steps`` products, or when every residual is below its ``tolerance`` times the right side.
    """
    x = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    first, live = beta.copy(), beta > 0
    v_old, v = np.zeros_like(rhs), np.divide(rhs, beta, out=np.zeros_like(rhs), where=live)
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    cos_old = cos = np.ones_like(beta)
    sin_old = sin = np.zeros_like(beta)
    eta, beta = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if not (live & (np.abs(eta) > tolerance * first)).any():
            break
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        # Givens rotations on the new column of the tridiagonal matrix.
        eps, delta = sin_old * beta, cos_old * beta
        delta, gamma = cos * delta + sin * alpha, cos * alpha - sin * delta
        rho = np.hypot(gamma, beta_new)
        live &= rho > 0
        safe = np.where(live, rho, 1.0)
        cos_old, sin_old = cos, sin
        cos, sin = gamma / safe, beta_new / safe
        w_old, w = w, np.where(live, (v - delta * w - eps * w_old) / safe, 0.0)
        x = x + np.where(live, cos * eta, 0.0) * w
        eta = -sin * eta
        go = live & (beta_new > 1e-14 * np.abs(alpha))
        v_old, v = v, np.divide(p, beta_new, out=np.zeros_like(p), where=go)
        live, beta = go, beta_new
    return x


def _orthonormal(new: np.ndarray, against: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Orthonormal basis of ``new`` outside the span of ``against``; vanishing columns are replaced by random ones."""
    out = np.empty((new.shape[0], 0))
    for column in new.T:
        if against.shape[1] + out.shape[1] >= new.shape[0]:
            break
        for attempt in range(4):
            basis, size = np.hstack([against, out]), np.linalg.norm(column)
            for _ in range(3):
                column = column - basis @ (basis.T @ column)
            left = np.linalg.norm(column)
            if size > 0 and left > 1e-10 * size:
                out = np.hstack([out, (column / left)[:, None]])
                break
            column = random.standard_normal(new.shape[0])
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest ``wanted`` eigenvalues, falling, of a symmetric positive semidefinite matrix that is only known by its
    ``product`` with matrices, their unit vectors as columns, and the number of products asked for."""
    random, asked = np.random.default_rng(seed), 0

    def times(u: np.ndarray) -> np.ndarray:
        nonlocal asked
        asked += 1
        return product(u)

    wanted = min(wanted, dim)
    locked, locked_image = np.empty((dim, 0)), np.empty((dim, 0))
    basis = _orthonormal(random.standard_normal((dim, min(dim, wanted + 2))), locked, random)
    image = times(basis)
    worst_before, stalled = math.inf, 0
    for _ in range(ROUNDS):
        small = basis.T @ image
        values, s = np.linalg.eigh((small + small.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        open_ = min(wanted - locked.shape[1], basis.shape[1])
        u, image_u = basis @ s[:, :open_], image @ s[:, :open_]
        residual = image_u - u * values[:open_]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        scale = max(float(np.abs(values).max()), float(np.abs((locked * locked_image).sum(axis=0)).max(initial=0.0)))
        limit = ROUNDINGS * np.finfo(float).eps * scale
        # Where no correction helps any more, what is left is rounding of the products.
        stalled = stalled + 1 if size.max() > worst_before / 2 and size.max() < 1e-12 * scale else 0
        worst_before = min(worst_before, float(size.max()))
        good = (size <= limit) | (stalled >= 3) | (basis.shape[1] + locked.shape[1] >= dim)
        first = int(np.argmin(good)) if not good.all() else open_  # lock in order, so that none is passed over
        if first:
            locked, locked_image = np.hstack([locked, u[:, :first]]), np.hstack([locked_image, image_u[:, :first]])
            if locked.shape[1] == wanted:
                break
            basis, image = basis @ s[:, first:], image @ s[:, first:]
            u, residual, values, size = u[:, first:], residual[:, first:], values[first:], size[first:]
            worst_before, stalled = math.inf, 0
        elif basis.shape[1] + open_ > min(WIDEST, dim):
            keep = min(basis.shape[1], 3 * wanted)
            basis, image = basis @ s[:, :keep], image @ s[:, :keep]
        theta = values[:u.shape[1]]

        def outside(t: np.ndarray) -> np.ndarray:
            """Project against the locked vectors and all current pairs."""
            t = t - locked @ (locked.T @ t)
            return t - u @ (u.T @ t)

        def shifted(t: np.ndarray) -> np.ndarray:
            t = outside(t)
            return outside(times(t) - t * theta)

        correction = minres(shifted, -outside(residual), INNER_STEPS, np.full(u.shape[1], 1e-3))
        room = max(1, dim - basis.shape[1] - locked.shape[1])
        new = _orthonormal(np.where(np.linalg.norm(correction, axis=0) > 0, correction, residual)[:, :room], np.hstack([locked, basis]), random)
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
    else:
        raise ArithmeticError(f"no convergence in {ROUNDS} rounds")
    small = locked.T @ locked_image
    values, s = np.linalg.eigh((small + small.T) / 2)
    vectors = locked @ s[:, ::-1]
    return values[::-1], vectors / np.linalg.norm(vectors, axis=0), asked


class Whitening:
    """Centre and components of the distinct vectors: ``n`` of them, exact ``sums`` a dimension, ``trace``, falling
    ``values`` and unit ``vectors`` (columns) of the covariance, and the ``identity_error`` of the whitened list.

    Components whose value is rounding of the largest one (1e-13 of it) carry nothing and are left out.
    """

    def __init__(self, fit: DataFrame, components: int = COMPONENTS):
        head = fit.select("n", F.length("block").alias("b")).first()
        self.n, self.sums, self.products = 0, [], 0
        self.trace, self.identity_error, self.values, self.vectors = 0.0, 0.0, np.empty(0), np.empty((0, 0))
        if head is None:
            return
        dim = head["b"] // (8 * head["n"])
        total = _totals(fit, lambda x: np.append(x.sum(axis=0), len(x)), "long")
        self.n, self.sums = int(total[-1]), [int(v) for v in total[:-1]]
        mean, n = np.array([s / self.n for s in self.sums]), self.n
        self.mean = mean

        def covariance_times(u: np.ndarray) -> np.ndarray:
            def own(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                return centred.T @ (centred @ u)

            return _totals(fit, own, "double").reshape(u.shape) / n

        self.trace = float(_totals(fit, lambda x: np.array([np.square(x - mean).sum()]), "double")[0]) / n
        if self.trace == 0:
            return
        values, vectors, self.products = jacobi_davidson(covariance_times, dim, components)
        some = values > 1e-13 * values[0]
        self.values, self.vectors = values[some], vectors[:, some]
        if len(self.values):
            axes = self.vectors / np.sqrt(self.values)

            def own(x: np.ndarray) -> np.ndarray:
                w = (x - mean) @ axes
                return np.vstack([w.T @ w, w.sum(axis=0)])

            square = _totals(fit, own, "double").reshape(-1, len(self.values)) / n
            covariance = square[:-1] - np.outer(square[-1], square[-1])
            self.identity_error = float(np.abs(covariance - np.eye(len(self.values))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of ``(n x - S)^2`` for each row, in exact integers."""
    if not len(x):
        return []
    most = n * max(int(x.max()), -int(x.min())) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 62:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


def projected(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """``x @ axes``, summed in one order for every row, so that equal rows give equal bits wherever they stand."""
    return np.stack([(x * axis).sum(axis=1) for axis in np.ascontiguousarray(axes.T)], axis=1)


@staged
def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Stored ``<key>, component, n, deviation, whitened, explained, identity_error``, one row for each row of ``rows``
    whose vector takes part and each component, numbered from 1 by falling share of the variance.

    Entries become ``floor(scale c)``; the model is fitted on each distinct vector once. Vectors that are null, empty or
    hold null or non-finite entries take no part; vectors of different lengths are an error. Null and repeated keys
    are rows like any other. With fewer dimensions, or where the variance is zero (a single distinct vector), there are
    fewer components, down to none and no rows. Equal variances may give any basis of their space, the same for all
    rows. A ``deviation`` beyond a long is an error. Other columns are not looked at.
    """
    spark = rows.sparkSession
    fit = fit_list(rows, column, scale)
    model = Whitening(fit, components)
    n, sums, error = model.n, model.sums, model.identity_error
    k, axes = len(model.values), model.vectors / np.sqrt(model.values) if len(model.values) else None
    explained = [float(v) / model.trace for v in model.values]
    mean = model.mean if n else None

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = whole(batch, 1, scale)
            if not len(good) or not k:
                continue
            keys = batch.column(0).take(pa.array(np.repeat(good, k)))
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(good))), pa.array(np.full(len(good) * k, n, np.int64)),
                pa.array(np.repeat(np.array(deviations(x, n, sums), np.int64), k)), pa.array(projected(x - mean, axes).ravel()),
                pa.array(np.tile(explained, len(good))), pa.array(np.full(len(good) * k, error)),
            ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with batch_rows(spark, ROWS):
        return materialize(rows.select(key, column).mapInArrow(out, schema), "whitened")
