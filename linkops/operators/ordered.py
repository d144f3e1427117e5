"""Running and trailing windows over long series.

A plain window puts a whole series into one task. Here rows are range-partitioned on (series, order), so a
series of any length spreads over many tasks; each range partition is one *chunk*. What has to cross a chunk
border is at most one row per chunk (running totals) or ``lag - 1`` rows per block (trailing frames).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .joins import null_safe_join

_ROW_BITS = 33


def chunked(df: DataFrame, series, order, chunks: int | None = None) -> DataFrame:
    """Add ``_chunk`` (ordered range id) and ``_idx`` (row in chunk); ``order`` must be unique in a series.

    The result is staged: range borders come from a sample, so they must not be drawn twice.
    """
    series, order = list(series), list(order)
    keys = [F.col(c) if isinstance(c, str) else c for c in series + order]
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_mid", mid)
    split = ranged.withColumns({
        "_chunk": F.shiftright("_mid", _ROW_BITS),
        "_idx": F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    }).drop("_mid")
    return materialize(split, "chunks")


def _chunk_window(series) -> Window:
    return Window.partitionBy("_chunk", *series).orderBy("_idx")


def chunk_offsets(chunks: DataFrame, series, sums: dict[str, Column]) -> DataFrame:
    """Totals of the earlier chunks of each series; only chunks that continue a series have a row.

    A series is contiguous over chunks, so there is at most one such row per chunk.
    """
    totals = chunks.groupBy("_chunk", *series).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*series) if series else Window.partitionBy()
    before = before.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_chunk", *series, *[F.sum(n).over(before).alias(f"_off_{n}") for n in sums],
        F.count(F.lit(1)).over(before).alias("_earlier"),
    ).where(F.col("_earlier") > 0).drop("_earlier")


def running_sums(df: DataFrame, series, order, sums: dict[str, Column], chunks: int | None = None) -> DataFrame:
    """Cumulative sums per series; ``sums`` maps output names to row values. ``F.lit(1)`` gives row numbers."""
    series = list(series)
    values = df.withColumns({f"_v_{name}": c for name, c in sums.items()})
    parts = chunked(values, series, order, chunks)
    offsets = chunk_offsets(parts, series, {name: F.col(f"_v_{name}") for name in sums})
    inside = _chunk_window(series).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({f"_run_{name}": F.sum(f"_v_{name}").over(inside) for name in sums})
    # At most one row per chunk, and the number of chunks is the number of range partitions.
    joined = null_safe_join(local, F.broadcast(offsets), ["_chunk", *series], "left")
    for name in sums:
        zero = F.lit(0)
        joined = joined.withColumn(name, F.col(f"_run_{name}") + F.coalesce(F.col(f"_off_{name}"), zero))
    drop = [f"_v_{n}" for n in sums] + [f"_run_{n}" for n in sums] + [f"_off_{n}" for n in sums]
    return joined.drop("_chunk", "_idx", *drop)


def row_numbers(chunks: DataFrame, out: str = "_row") -> DataFrame:
    """Global zero-based row number of a chunked frame: chunk counts give the offset, no window over rows."""
    sizes = chunks.groupBy("_chunk").agg((F.max("_idx") + 1).alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return chunks.join(F.broadcast(starts), "_chunk").withColumn(out, F.col("_start") + F.col("_idx")).drop("_start")


def with_halo(df: DataFrame, series, order, lag: int, block_rows: int | None = None,
              chunks: int | None = None) -> DataFrame:
    """Blocks of consecutive rows plus the ``lag`` rows before each block (flag ``_halo``).

    Columns ``_block`` and ``_row`` are added; windows partitioned by ``(_block, *series)`` and ordered by
    ``_row`` see every frame of up to ``lag`` preceding rows whole. Blocks have equal size whatever the series.
    """
    size = max(block_rows or 100_000, 1)
    numbered = row_numbers(chunked(df, series, order, chunks)).drop("_chunk", "_idx")
    return halo_blocks(numbered, lag, size)


def halo_blocks(numbered: DataFrame, lag: int, size: int) -> DataFrame:
    """Copy each row into its own block of ``size`` rows and into the later blocks that start within ``lag`` rows."""
    own = F.floor(F.col("_row") / F.lit(size)).cast("bigint")
    reach = F.floor((F.col("_row") + F.lit(lag)) / F.lit(size)).cast("bigint")
    return (
        numbered.withColumn("_own", own).withColumn("_block", F.explode(F.sequence("_own", reach)))
        .withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own")
    )


def segments(pdf, keys) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys in a pandas block that is sorted by series."""
    if not len(pdf):
        return []
    change = np.zeros(len(pdf), dtype=bool)
    for key in keys:
        values = pdf[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    starts = np.concatenate(([0], np.nonzero(change)[0]))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]))


class _Prefix:
    """Running sums of values inside a block. The sum of any frame is a difference of two of them, whatever its length.

    Whole numbers are added exactly. A double is cut into a multiple of ``2 ** -bits``, whose sums are exact too, and
    a rest that is smaller than the largest value by the bits that are left, so the difference of two long sums does
    not lose what a short frame holds. NaN and infinities are counted apart instead of spoiling all later sums.
    """

    def __init__(self, name: str, value: Column, kind, stats, rows: int):
        self.name, self.bits = name, None
        nulls, most, odd = stats
        self.nulls, self.odd = bool(nulls), bool(odd)
        self.whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        if self.whole:
            wide = most is not None and most * rows >= 1 << 62
            clean = value.cast("decimal(38,0)") if wide else value.cast("bigint")
            self.parts = {"q": F.coalesce(clean, F.lit(0))}
        else:
            x = value.cast("double")
            finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
            size = math.frexp(most)[1] if most else 0
            self.bits = max(-1000, min(1000, 61 - size - rows.bit_length()))
            q = F.floor(finite * F.lit(2.0 ** self.bits) + 0.5)
            self.parts = {"q": q, "r": finite - q * F.lit(2.0 ** -self.bits)}
            if self.odd:
                self.parts |= {"nan": F.isnan(x).cast("bigint"), "up": (x == float("inf")).cast("bigint"), "down": (x == float("-inf")).cast("bigint")}
                self.parts = {k: F.coalesce(c, F.lit(0)) for k, c in self.parts.items()}
        if self.nulls:
            self.parts["n"] = value.isNotNull().cast("bigint")

    def columns(self, window) -> dict[str, Column]:
        inside = window.rowsBetween(Window.unboundedPreceding, 0)
        return {f"_{part}_{self.name}": F.sum(c).over(inside) for part, c in self.parts.items()}

    def _frame(self, part: str, window, lag: int, start: int) -> Column:
        run = F.col(f"_{part}_{self.name}")
        return (F.lag(run, start).over(window) if start else run) - F.coalesce(F.lag(run, lag + start).over(window), F.lit(0))

    def count(self, window, lag: int, start: int) -> Column:
        """Values in the frame; null or 0 where it has none."""
        if self.nulls:
            return self._frame("n", window, lag, start)
        return F.least(F.col("_place") - F.lit(start), F.lit(lag))

    def sum(self, window, lag: int, start: int) -> Column:
        total = self._frame("q", window, lag, start)
        if self.whole:
            return total
        total = total * F.lit(2.0 ** -self.bits) + self._frame("r", window, lag, start)
        if not self.odd:
            return total
        nan, up, down = (self._frame(part, window, lag, start) > 0 for part in ("nan", "up", "down"))
        return F.when(nan | (up & down), F.lit(float("nan"))).when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf"))).otherwise(total)


def _prefixes(df: DataFrame, series, order, columns, reach: int, block_rows: int | None) -> tuple[DataFrame, dict[str, _Prefix], Window]:
    """Rows with running sums of ``columns`` and a flag ``_halo``, and the window in which the sums run.

    Where no series has more than ``block_rows`` rows, each is a block as it is, and one shuffle is all it takes. Else
    blocks of consecutive rows get a halo of ``reach`` rows, so that a long series spreads over many tasks.
    """
    size = max(block_rows or 100_000, 1)
    kinds, aggs = {f.name: f.dataType for f in df.schema}, [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        finite = F.abs(F.col(c).cast("double"))
        good = finite < float("inf")  # NaN is larger than all numbers
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls{i}"), F.max(F.when(good, finite)).alias(f"most{i}"), F.count_if(~good).alias(f"odd{i}")]
    merged = [F.max("n").alias("n")]
    for i in range(len(columns)):
        merged += [F.sum(f"nulls{i}").alias(f"nulls{i}"), F.max(f"most{i}").alias(f"most{i}"), F.sum(f"odd{i}").alias(f"odd{i}")]
    row = df.groupBy(*series).agg(*aggs).agg(*merged).first()
    held = {c: _Prefix(c, F.col(c), kinds[c], (row[f"nulls{i}"], row[f"most{i}"], row[f"odd{i}"]), size + reach) for i, c in enumerate(columns)}
    if (row["n"] or 0) <= size:
        window = Window.partitionBy(*series).orderBy(*order)
        blocks = df.withColumn("_halo", F.lit(False))
    else:
        window = Window.partitionBy("_block", *series).orderBy("_row")
        blocks = halo_blocks(row_numbers(chunked(df, series, order)).drop("_chunk", "_idx"), reach, size)
    sums = {n: c for p in held.values() for n, c in p.columns(window).items()}
    return blocks.withColumns({"_place": F.row_number().over(window), **sums}), held, window


def trailing(df: DataFrame, series, order, lags: dict[str, tuple[str, int]], start: int = 0,
             block_rows: int | None = None) -> DataFrame:
    """Trailing means: output name to (column, lag). The frame is the ``lag`` rows ending ``start`` rows ago.

    Shorter prefixes average what is there (a minimum of one value). Every mean is a difference of two running sums,
    so its cost does not depend on the lag.
    """
    series = list(series)
    reach = max(lag for _, lag in lags.values()) + start
    columns = list(dict.fromkeys(column for column, _ in lags.values()))
    blocks, held, window = _prefixes(df, series, order, columns, reach, block_rows)

    def mean(column: str, lag: int) -> Column:
        n = held[column].count(window, lag, start)
        return F.when(n > 0, (held[column].sum(window, lag, start) / n).cast("double"))

    out = blocks.withColumns({name: mean(column, lag) for name, (column, lag) in lags.items()})
    return out.where(~F.col("_halo")).select(*df.columns, *lags)


def windowed_error_rate(df: DataFrame, series, order, window_slots: int, error: Column,
                        compat: bool = False, out: str = "bler_window") -> DataFrame:
    """Block-error rate before each slot: mean of all earlier slots during warm-up, then of the last W slots.

    ``compat`` sums W+1 slots but still divides by W once the warm-up is over. The first slot has no rate.
    """
    series = list(series)
    rows = df.withColumn("_err", error.cast("bigint"))
    blocks, held, window = _prefixes(rows, series, order, ["_err"], window_slots + 2, None)
    err = held["_err"]
    seen = err.count(window, window_slots, 1)
    rate = F.when(seen > 0, err.sum(window, window_slots, 1) / seen)
    if compat:
        over = err.count(window, window_slots + 1, 1) > window_slots
        rate = F.when(over, err.sum(window, window_slots + 1, 1) / F.lit(window_slots)).otherwise(rate)
    return blocks.withColumn(out, rate).where(~F.col("_halo")).select(*df.columns, out)


def padded_rolling(df: DataFrame, order: str, columns, width: int, series=()) -> DataFrame:
    """Rolling mean of a binned series; the first ``width - 1`` rows repeat the first full window.

    For aggregated bins only (one row per bin).
    """
    if width <= 1:
        return df
    base = Window.partitionBy(*series).orderBy(order)
    frame = base.rowsBetween(-(width - 1), 0)
    whole = Window.partitionBy(*series)
    numbered = df.withColumn("_rn", F.row_number().over(base))
    rolled = numbered.withColumns({
        f"_m_{c}": F.when(F.col("_rn") >= width, F.avg(c).over(frame)) for c in columns
    })
    out = rolled.withColumns({
        c: F.coalesce(f"_m_{c}", F.max(F.when(F.col("_rn") == width, F.col(f"_m_{c}"))).over(whole)) for c in columns
    })
    return out.drop("_rn", *[f"_m_{c}" for c in columns])


def systematic_sample(df: DataFrame, order, target: int = 10_000) -> DataFrame:
    """Every n-th row in order, with n = max(1, rows // target)."""
    numbered = row_numbers(chunked(df, [], order)).drop("_chunk", "_idx")
    total = numbered.agg(F.count(F.lit(1)).alias("_total"))
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / F.least(F.lit(target), F.col("_total"))))
    return numbered.join(F.broadcast(total)).where(F.col("_row") % step == 0).drop("_row", "_total")


def first_per_group(df: DataFrame, keys, order, columns) -> DataFrame:
    """First row of each group in order, by partial aggregation (no sort)."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*")
