"""Monotone least-squares fits: pool-adjacent-violators over series of any length, and over two axes.

Pooling may be done in any order. So every chunk of a series is pooled by itself, which leaves rising blocks; after
that only blocks that overlap the values of another chunk can still change. Those alone are brought together, eight
chunks at a time, until nothing overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side, staged
from .joins import null_safe_join
from .ordered import chunked

# Chunks brought together in one round, and numpy passes before the rest is pooled block by block.
MERGED = 8
PASSES = 40


def pool(starts: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First element, weight and weighted sum of each block of a rising fit; ``starts`` marks where a series begins.

    A pass pools every falling run at once. A fall that eats its way back through a long rise, one block a pass, is
    left to a loop with a stack.
    """
    first = np.arange(len(weight))
    for _ in range(PASSES):
        mean = total / weight
        falls = (mean[1:] < mean[:-1]) & ~starts[first[1:]]
        if not falls.any():
            return first, weight, total
        at = np.flatnonzero(np.concatenate(([True], ~falls)))
        first, weight, total = first[at], np.add.reduceat(weight, at), np.add.reduceat(total, at)
    blocks: list[list] = []
    for f, w, t in zip(first.tolist(), weight.tolist(), total.tolist()):
        blocks.append([f, w, t])
        while len(blocks) > 1 and not starts[blocks[-1][0]] and blocks[-1][2] / blocks[-1][1] < blocks[-2][2] / blocks[-2][1]:
            _, w, t = blocks.pop()
            blocks[-1][1] += w
            blocks[-1][2] += t
    return tuple(np.array(x) for x in zip(*blocks))


def _pooled(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Blocks of rows that are sorted by ``unit`` and order inside each partition: a column layout like that of the
    rows, ``_w`` and ``_s`` being those of the block and all else that of its first row."""
    names = rows.columns
    at_w, at_s = names.index("_w"), names.index("_s")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            starts = np.zeros(table.num_rows, bool)
            starts[0] = True
            for name in unit:
                starts[1:] |= _changes(table.column(name))
            first, w, s = pool(starts, table.column(at_w).to_numpy().copy(), table.column(at_s).to_numpy().copy())
            blocks = table.take(pa.array(first)).set_column(at_w, "_w", pa.array(w)).set_column(at_s, "_s", pa.array(s))
            last = int(np.flatnonzero(starts[first])[-1])  # the last series may go on in the next batch
            yield from blocks.slice(0, last).combine_chunks().to_batches()
            held = blocks.slice(last).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    return rows.mapInArrow(solve, rows.schema)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before; null equals null."""
    import pyarrow.compute as pc

    codes = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    index = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    return index[1:] != index[:-1]


@staged
def isotonic_fit(df: DataFrame, series, x: str, y: str, weight: Column | None = None, increasing: bool = True) -> DataFrame:
    """Stored ``series…, x, weight, fit``: the monotone function of ``x`` nearest to ``y`` in weighted squares.

    One row for each different ``x`` of a series; rows that share it are one point of their summed weight. Rows
    without ``x``, a finite ``y`` or a positive weight take no part; null is a series like any other.
    """
    series = list(series)
    sign = 1.0 if increasing else -1.0
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    rows = df.select(*series, F.col(x).alias("_x"), w.alias("_w"), (w * F.col(y).cast("double") * F.lit(sign)).alias("_s"))
    rows = rows.where(F.col("_x").isNotNull() & (F.col("_w") > 0) & (F.abs("_s") < float("inf")))
    points = rows.groupBy(*series, "_x").agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
    parts = chunked(points, series, ["_x"])
    active = parts.select(*series, "_chunk", "_idx", F.col("_chunk").alias("_group"), "_w", "_s")
    active = active.repartition("_chunk").sortWithinPartitions("_chunk", "_idx")
    active = materialize(_pooled(active, ["_chunk", *series]), "blocks")
    done = []
    while True:
        mean = F.col("_s") / F.col("_w")
        units = active.groupBy(*series, "_group").agg(F.min(mean).alias("_low"), F.max(mean).alias("_high"))
        order = Window.partitionBy(*series).orderBy("_group") if series else Window.orderBy("_group")  # a row per chunk
        units = units.select(
            *series, "_group", F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"),
            F.min("_low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_below"),
        )
        units = small_side(materialize(units, "units"))
        open_ = F.coalesce(mean < F.col("_above"), F.lit(False)) | F.coalesce(mean > F.col("_below"), F.lit(False))
        marked = materialize(null_safe_join(active, units, [*series, "_group"]).select(*active.columns, open_.alias("_open")), "marked")
        done.append(marked.where(~F.col("_open")).drop("_open"))
        if not marked.where("_open").limit(1).count():
            break
        together = marked.where("_open").drop("_open").withColumn("_group", F.floor(F.col("_group") / F.lit(MERGED)))
        together = together.repartition("_group").sortWithinPartitions("_group", *series, "_chunk", "_idx")
        active = materialize(_pooled(together, ["_group", *series]), "blocks")
    blocks = reduce(DataFrame.unionByName, done).select(*series, "_chunk", "_idx", (F.col("_s") / F.col("_w") * F.lit(sign)).alias("_fit"))
    blocks = materialize(blocks, "fit-blocks")
    # A block begins in one chunk and may run through later ones.
    last = blocks.groupBy(*series, "_chunk").agg(F.max_by("_fit", "_idx").alias("_last"))
    units = null_safe_join(parts.select(*series, "_chunk").distinct(), last, [*series, "_chunk"], "left")
    before = Window.partitionBy(*series).orderBy("_chunk") if series else Window.orderBy("_chunk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = materialize(units.select(*series, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carry")), "carry")
    begun = null_safe_join(parts, blocks, [*series, "_chunk", "_idx"], "left")
    inside = Window.partitionBy("_chunk", *series).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    run = begun.withColumn("_run", F.last("_fit", ignorenulls=True).over(inside))
    out = null_safe_join(run, small_side(carry), [*series, "_chunk"], "left")
    return out.select(*series, F.col("_x").alias(x), F.col("_w").alias("weight"), (F.coalesce("_run", "_carry") + 0.0).alias("fit"))


def _axis_pass(cells: DataFrame, series: str, x: str, value: str, increasing: bool) -> DataFrame:
    """``cells`` with ``_fit``: the monotone fit of ``value`` along ``x`` in every ``series``. An axis is a list of
    codes, so a task holds one series at a time."""
    names, sign = cells.columns, 1.0 if increasing else -1.0
    at = names.index(value), names.index("_w"), names.index(series)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = np.zeros(table.num_rows, bool)
            starts[0] = True
            starts[1:] = _changes(table.column(at[2]))
            w = table.column(at[1]).to_numpy()
            first, pw, ps = pool(starts, w.copy(), w * table.column(at[0]).to_numpy() * sign)
            fit = np.repeat(ps / pw * sign, np.diff(np.append(first, table.num_rows)))
            return table.append_column("_fit", pa.array(fit)).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(at[2])
            cut = batch.num_rows if own[0] == own[-1] else int(np.flatnonzero(_changes(pa.chunked_array([own])))[-1]) + 1
            if held and held[-1].column(at[2])[-1] != own[0]:
                yield close()
                held.clear()
            held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield close()
                held[:] = [batch.slice(cut)]
        if held:
            yield close()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema), "_fit double"])
    return cells.repartition(series).sortWithinPartitions(series, x).mapInArrow(solve, schema)


@staged
def isotonic_grid(df: DataFrame, x: str, z: str, y: str, weight: Column | None = None, increasing=(True, True),
                  tolerance: float = 1e-9, rounds: int = 500) -> DataFrame:
    """Stored ``x, z, weight, fit``: the function monotone in ``x`` and in ``z`` nearest to ``y`` in weighted squares.

    Dykstra's method: passes along both axes in turn, each correcting what the other one took last time, until a round
    moves no cell by more than ``tolerance``. One row for each cell that has data. Null codes, values that are not finite
    and weights that are not positive take no part.
    """
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    rows = df.select(F.col(x).alias("_x"), F.col(z).alias("_z"), w.alias("_w"), (w * F.col(y).cast("double")).alias("_s"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_z").isNotNull() & (F.col("_w") > 0) & (F.abs("_s") < float("inf")))
    cells = rows.groupBy("_x", "_z").agg(F.sum("_w").alias("_w"), (F.sum("_s") / F.sum("_w")).alias("_f"))
    state = materialize(cells.withColumns({"_p": F.lit(0.0), "_q": F.lit(0.0)}), "grid")
    for _ in range(rounds):
        along = _axis_pass(state.withColumn("_v", F.col("_f") + F.col("_p")), "_z", "_x", "_v", increasing[0])
        along = along.select("_x", "_z", "_w", "_f", (F.col("_v") - F.col("_fit")).alias("_p"), "_q", (F.col("_fit") + F.col("_q")).alias("_v"))
        both = _axis_pass(along, "_x", "_z", "_v", increasing[1])
        state = materialize(both.select(
            "_x", "_z", "_w", F.col("_fit").alias("_f"), "_p", (F.col("_v") - F.col("_fit")).alias("_q"), F.abs(F.col("_fit") - F.col("_f")).alias("_moved"),
        ), "grid")
        moved = state.agg(F.max("_moved")).first()[0]
        state = state.drop("_moved")
        if moved is None or moved <= tolerance:
            break
    return state.select(F.col("_x").alias(x), F.col("_z").alias(z), F.col("_w").alias("weight"), F.col("_f").alias("fit"))
