"""Exact quantiles per group by narrowing histograms, without collecting or sorting a group.

A pass counts the values of a group into a bounded number of bins, with the least and the greatest value of each. A
wanted rank lies in one bin; the next pass cuts only that bin, until its least and greatest value are one. What is
shuffled is one row for each bin that has values, whatever the number of rows and of different values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, materialize, small_side
from .joins import null_safe_join

# Bins of an interval, and of each power of two in the first pass.
BINS = 4_096
OCTAVE_BINS = 64
_POWERS = 2_100
# Values and bins that a task holds while it counts the values of arrays; stands for a null label.
HELD_VALUES, NO_LABEL = 2_000_000, -(1 << 40)


def _position(n: Column, q: Column, method: str) -> Column:
    """Zero-based fractional position of quantile ``q`` among ``n`` sorted values."""
    if method == "nearest":
        return F.floor((n - 1) * q + 0.5).cast("double")
    if method == "linear":
        return ((n - 1) * q).cast("double")
    if method == "midpoint":
        return F.least(F.greatest(n * q - F.lit(0.5), F.lit(0.0)), (n - 1).cast("double"))
    raise ValueError(f"unknown method {method!r}")


def _power(x: Column) -> Column:
    """Bin of a value by sign and logarithm; rises with the value, infinities have bins of their own."""
    size = F.floor((F.log2(F.abs(x)) + 1_075) * OCTAVE_BINS) + 1
    far = F.lit(_POWERS * OCTAVE_BINS)
    return F.when(x == 0, 0).when(F.abs(x) == float("inf"), F.signum(x) * far).otherwise(F.signum(x) * size).cast("int")


def _share(x: Column, low: Column, high: Column) -> Column:
    """Bin of a value between ``low`` and ``high``. Every step rounds monotonely, so the bins are in order, and the two
    ends are never in one bin."""
    half = (x / 2 - low / 2) / (high / 2 - low / 2)  # where the difference is too large for a double
    place = F.when(high - low < float("inf"), (x - low) / (high - low)).otherwise(half)
    return F.least(F.floor(place * BINS), F.lit(BINS - 1)).cast("int")


def _counted(rows: DataFrame, keys, interval: Column, bin_: Column) -> DataFrame:
    """Stored bins with their number of values, range, and the number of values of the interval before them."""
    return _placed(rows.groupBy(*keys, interval.alias("_interval"), bin_.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"),
    ), keys)


def _placed(bins: DataFrame, keys) -> DataFrame:
    order = Window.partitionBy(*keys, "_interval").orderBy("_bin")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return materialize(bins.withColumn("_before", before), "bins")


class _Rows:
    """Values ``_x`` in rows of their own."""

    def __init__(self, rows: DataFrame, keys):
        self.rows, self.keys = rows, list(keys)

    def counted(self) -> DataFrame:
        return _counted(self.rows, self.keys, F.lit(0.0), _power(F.col("_x")))

    def inside(self, intervals: DataFrame) -> DataFrame:
        """``keys…, _x, _from, _to`` of the values between ``_low`` and ``_high``."""
        rows, keys = self.rows, self.keys
        inside = null_safe_join(rows, small_side(intervals), keys) if keys else rows.join(F.broadcast(intervals))  # an interval a rank
        inside = inside.where(F.col("_x").between(F.col("_low"), F.col("_high")))
        return inside.select(*keys, "_x", F.col("_low").alias("_from"), F.col("_high").alias("_to"))


class ArrayValues:
    """Values that travel as an array of structs ``(label, value, …)`` inside rows with whole-number keys; rows with a
    null key are left out.

    Rows are never multiplied in Spark: Arrow batches go to bins, and to the values between given ends, at once.
    """

    def __init__(self, df: DataFrame, keys, array: str, label: str, value: str):
        self.cells, self.keys, self.label, self.value = list(keys), [*keys, label], label, value
        whole = [F.col(k).cast("long").alias(k) for k in self.cells]
        self.rows = df.select(*whole, array).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.cells]))
        self.schema = "".join(f"`{k}` long, " for k in self.cells) + f"`{label}` int, "

    def __getstate__(self):
        return self.__dict__ | {"rows": None}  # tasks know the layout only

    def _values(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Row, keys of the rows, label and value of all values of a batch; a null label is ``NO_LABEL``."""
        array = batch.column(len(self.cells))
        flat = array.flatten()
        fields = dict(zip((f.name for f in flat.type), flat.flatten()))
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))
        x = pc.cast(fields[self.value], pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # negative zero is zero
        label = pc.fill_null(pc.cast(fields[self.label], pa.int64()), NO_LABEL).to_numpy(zero_copy_only=False)
        real = ~np.isnan(x)
        return row[real], [batch.column(i).to_numpy() for i in range(len(self.cells))], label[real], x[real]

    def _batch(self, keys: list[np.ndarray], label: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        named = dict(zip(self.cells, keys)) | {self.label: pa.array(label.astype(np.int32), pa.int32(), mask=label == NO_LABEL)}
        return pa.RecordBatch.from_pydict(named | columns)

    def counted(self) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0

            def merged() -> tuple[np.ndarray, ...]:
                *by, n, low, high = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort(by)
                by, n, low, high = [c[order] for c in by], n[order], low[order], high[order]
                first = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in by], axis=0))))
                return *(c[first] for c in by), np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)

            def out() -> pa.RecordBatch:
                *keys, label, bin_, n, low, high = parts[0]
                return self._batch(keys, label, _bin=bin_.astype(np.int32), _n=n, _low=low, _high=high)

            for batch in batches:
                row, keys, label, x = self._values(batch)
                if not len(x):
                    continue
                with np.errstate(divide="ignore"):
                    power = np.floor((np.log2(np.abs(x)) + 1_075) * OCTAVE_BINS) + 1
                power = np.where(x == 0, 0, np.sign(x) * np.where(np.isinf(x), _POWERS * OCTAVE_BINS, power)).astype(np.int64)
                parts.append((*(k[row] for k in keys), label, power, np.ones(len(x), np.int64), x, x))
                size += len(x)
                if size >= HELD_VALUES:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size >= HELD_VALUES // 2:
                        yield out()
                        parts, size = [], 0
            if parts:
                parts = [merged()]
                yield out()

        bins = self.rows.mapInArrow(count, self.schema + "_bin int, _n long, _low double, _high double")
        bins = bins.groupBy(*self.keys, F.lit(0.0).alias("_interval"), "_bin").agg(
            F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
        )
        return _placed(bins, self.keys)

    def inside(self, intervals: DataFrame) -> DataFrame:
        intervals = materialize(intervals, "intervals")
        size = intervals.count()
        if size > BROADCAST_ROWS:
            return _Rows(self._long(), self.keys).inside(intervals)
        table = intervals.toPandas()
        table[self.label] = table[self.label].astype("float64").fillna(NO_LABEL).astype("int64")
        cells, labels = pd.MultiIndex.from_frame(table[self.cells].drop_duplicates()), np.unique(table[self.label])
        layer = table.groupby(self.keys).cumcount().to_numpy()
        shape = (int(layer.max()) + 1, len(cells), len(labels))
        if np.prod(shape) > 8 * BROADCAST_ROWS:
            return _Rows(self._long(), self.keys).inside(intervals)
        ends = np.full((2, *shape), np.nan)
        at = layer, cells.get_indexer(pd.MultiIndex.from_frame(table[self.cells])), np.searchsorted(labels, table[self.label])
        ends[0][at], ends[1][at] = table["_low"], table["_high"]
        shared = self.rows.sparkSession.sparkContext.broadcast((cells, labels, ends))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, labels, ends = shared.value
            for batch in batches:
                row, keys, label, x = self._values(batch)
                cell = cells.get_indexer(pd.MultiIndex.from_arrays(keys))[row]
                place = np.minimum(np.searchsorted(labels, label), len(labels) - 1)
                known = (cell >= 0) & (labels[place] == label)
                for low, high in zip(*ends):
                    a, b = low[cell, place], high[cell, place]
                    hit = np.flatnonzero(known & (x >= a) & (x <= b))
                    yield self._batch([k[row[hit]] for k in keys], label[hit], _x=x[hit], _from=a[hit], _to=b[hit])

        return self.rows.mapInArrow(pick, self.schema + "_x double, _from double, _to double")

    def _long(self) -> DataFrame:
        def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, keys, label, x = self._values(batch)
                yield self._batch([k[row] for k in keys], label, _x=x)

        return self.rows.mapInArrow(long, self.schema + "_x double")


def ranked_values(source: _Rows | ArrayValues, wanted) -> DataFrame:
    """``keys…, _rank, _value``: the values at zero-based ranks. ``wanted`` makes a frame of ``keys…, _rank``
    from one of ``keys…, _n``, the sizes of the groups."""
    keys = source.keys
    bins = source.counted()
    sizes = bins.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    asked = wanted(sizes).select(*keys, "_rank", F.lit(0.0).alias("_interval"), F.col("_rank").alias("_at"))
    out = None
    while True:
        met = null_safe_join(asked, bins, [*keys, "_interval"])
        hit = met.where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_n")))
        hit = materialize(hit.select(*keys, "_rank", (F.col("_at") - F.col("_before")).alias("_at"), "_low", "_high"), "hits")
        found = hit.where(F.col("_low") == F.col("_high")).select(*keys, "_rank", F.col("_low").alias("_value"))
        out = found if out is None else out.unionByName(found)
        asked = hit.where(F.col("_low") < F.col("_high"))
        # The intervals of a group do not overlap, so their lower ends name them.
        intervals = asked.select(*keys, "_low", "_high").distinct()
        if not asked.limit(1).count():
            return out
        # A small part of the values, which is all that later passes have to read.
        inside = materialize(source.inside(intervals), "inside")
        source = _Rows(inside.select(*keys, "_x"), keys)
        bins = _counted(inside, keys, F.col("_from"), _share(F.col("_x"), F.col("_from"), F.col("_to")))
        asked = asked.select(*keys, "_rank", F.col("_low").alias("_interval"), "_at")


def grouped_quantiles(df: DataFrame | ArrayValues, keys, value: str, qs, method: str = "linear") -> DataFrame:
    """``(keys…, q, value)`` for every q in ``qs``.

    ``linear`` interpolates between ranks, ``nearest`` takes the closest rank, ``midpoint`` puts sample i at
    (i - 1/2)/n and interpolates. Nulls and NaN are ignored. ``df`` is read twice: for the first histogram,
    and for the values in the bins of the wanted ranks. Values may also lie in arrays (:class:`ArrayValues`).
    """
    keys, source = list(keys), df
    if isinstance(df, DataFrame):
        x = F.col(value).cast("double") + 0.0  # negative zero is zero
        source = _Rows(df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")), keys)
    held = []

    def wanted(sizes: DataFrame) -> DataFrame:
        asked = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        asked = asked.withColumn("_pos", _position(F.col("_n"), F.col("q"), method))
        held.append(asked.withColumns({"_lo": F.floor("_pos"), "_hi": F.ceil("_pos")}))
        return held[0].select(*keys, F.explode(F.array("_lo", "_hi")).alias("_rank")).distinct()

    values = small_side(ranked_values(source, wanted))  # over stored hits
    low = values.select(*keys, F.col("_rank").alias("_lo"), F.col("_value").alias("_a"))
    high = values.select(*keys, F.col("_rank").alias("_hi"), F.col("_value").alias("_b"))
    both = null_safe_join(null_safe_join(held[0], low, [*keys, "_lo"]), high, [*keys, "_hi"])
    # Between equal values, and at a rank, there is nothing to add, not even to an infinity.
    part = F.when((F.col("_pos") == F.col("_lo")) | (F.col("_a") == F.col("_b")), 0.0).otherwise((F.col("_pos") - F.col("_lo")) * (F.col("_b") - F.col("_a")))
    return both.select(*keys, "q", (F.col("_a") + part).alias(value))
