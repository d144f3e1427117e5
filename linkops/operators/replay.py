"""Sequential link adaptation replayed over long series.

Both replays are state machines: each row maps the incoming state to the next. A series of any length is cut
into blocks of rows. For blocks that continue, the block's whole state map is computed (all states at once),
the maps are applied in order to find each block's true starting state, and then every block replays on its
own. No series is processed row by row in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.radio import MCS_MAX
from ..session import materialize, small_side
from .candidates import matrix
from .ordered import segments, with_halo


@dataclass(frozen=True)
class Machine:
    """State machine over rows. States are integers.

    ``summarize(inputs, n0)`` gives the state map of a block as integer pieces ``(start, out, slope)`` sorted by
    start; ``replay(inputs, n0, state)`` gives the output column. ``inputs`` are NumPy columns, ``n0`` the rows
    of the series before the block.
    """

    inputs: tuple[str, ...]
    initial: int
    summarize: Callable
    replay: Callable


def _pieces(states: np.ndarray, outs: np.ndarray) -> list[tuple[int, int, int]]:
    """Compress a state map into affine pieces."""
    slopes = np.diff(outs)
    pieces, i, n = [], 0, len(states)
    while i < n:
        slope = int(slopes[i]) if i < n - 1 else 0
        j = i
        while j < n - 1 and slopes[j] == slope:
            j += 1
        pieces.append((int(states[i]), int(outs[i]), slope))
        i = j + 1 if j > i else i + 1
    return pieces


def _apply(starts, outs, slopes, state: int) -> int:
    at = max(int(np.searchsorted(starts, state, side="right")) - 1, 0)
    return int(outs[at] + slopes[at] * (state - starts[at]))


def _compose(machine: Machine, key_columns):
    """Streaming pass over block maps sorted by (series, block): only one state is kept."""

    def run(batches):
        current, state = None, machine.initial
        for batch in batches:
            keys = list(zip(*[batch[k] for k in key_columns])) if key_columns else [()] * len(batch)
            begin = []
            for i, key in enumerate(keys):
                if key != current:
                    current, state = key, machine.initial
                begin.append(state)
                starts = batch["starts"].iat[i]
                if starts is not None and len(starts):
                    state = _apply(np.asarray(starts), np.asarray(batch["outs"].iat[i]),
                                   np.asarray(batch["slopes"].iat[i]), state)
            out = batch[["_block", *key_columns]].copy()
            out["_state"] = begin
            yield out

    return run


def replay(df: DataFrame, series, order, machine: Machine, out: str, block_rows: int = 20_000) -> DataFrame:
    """Add the machine's output column ``out`` (int) to every row, per series in order."""
    series = list(series)
    rows = with_halo(df, series, order, 0, block_rows).drop("_halo")
    per_block = rows.groupBy("_block", *series).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*series).orderBy("_block")
    groups = per_block.select(
        "_block", *series,
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n0"),
        F.lead("_block").over(along).isNotNull().alias("_continues"),
    )
    # Series that stay inside one block start from the initial state; the others number about one per block.
    borders = materialize(groups.where((F.col("_n0") > 0) | F.col("_continues")), "borders")
    on = ["_block", *series]
    key_fields = [rows.schema[k] for k in series]
    map_schema = T.StructType([
        T.StructField("_block", T.LongType()), *key_fields,
        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("outs", T.ArrayType(T.LongType())),
        T.StructField("slopes", T.ArrayType(T.LongType())),
    ])

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        pieces = machine.summarize([pdf[c].to_numpy() for c in machine.inputs], int(pdf["_n0"].iat[0]))
        columns = list(zip(*pieces))
        head = {"_block": [int(pdf["_block"].iat[0])], **{k: [pdf[k].iat[0]] for k in series}}
        return pd.DataFrame({**head, "starts": [list(columns[0])], "outs": [list(columns[1])], "slopes": [list(columns[2])]})

    continuing = rows.select("_row", *on, *machine.inputs).join(
        small_side(borders.where("_continues").drop("_continues")), on
    )
    # At most one series per block continues, so the block alone is the group.
    maps = continuing.groupBy("_block").applyInPandas(summarize, map_schema)
    chained = borders.join(maps, on, "left").select(*on, "starts", "outs", "slopes")
    chained = (chained.repartition(*series) if series else chained.coalesce(1)).sortWithinPartitions(*series, "_block")
    state_schema = T.StructType([T.StructField("_block", T.LongType()), *key_fields, T.StructField("_state", T.LongType())])
    states = materialize(chained.mapInPandas(_compose(machine, series), state_schema), "states")
    begin = borders.select(*on, "_n0").join(states, on)

    kept = [c for c in rows.columns if c not in ("_row", "_block")]
    out_schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # One group per block: series lie one after the other in it, which keeps many short series cheap.
        pdf = pdf.sort_values("_row")
        inputs = [pdf[c].to_numpy() for c in machine.inputs]
        n0, state = pdf["_n0"].to_numpy(), pdf["_state"].to_numpy()
        values = np.empty(len(pdf), dtype=np.int32)
        for begin_at, end_at in segments(pdf, series):
            part = [c[begin_at:end_at] for c in inputs]
            values[begin_at:end_at] = machine.replay(part, int(n0[begin_at]), int(state[begin_at]))
        return pdf[kept].assign(**{out: values})

    started = rows.join(small_side(begin), on, "left").na.fill({"_n0": 0, "_state": machine.initial})
    return started.groupBy("_block").applyInPandas(run, out_schema)


# --- offset loop (OLLA) ----------------------------------------------------------------------------

def success_mask(threshold: Column, cand: str = "cand") -> Column:
    """Bit m is set when the candidate with MCS m succeeds (p >= threshold)."""
    return F.arrow_udf(_met, "int")(F.col(cand), threshold.cast("double"))


def _met(cand: pa.Array, threshold: pa.Array) -> pa.Array:
    p, inside = matrix(cand, "p")
    flat = cand.flatten()
    known = np.zeros(inside.shape, bool)
    known[inside] = flat.field("p").is_valid().to_numpy(zero_copy_only=False)
    least = pc.cast(threshold, pa.float64()).to_numpy(zero_copy_only=False)[:, None]
    met = known & threshold.is_valid().to_numpy(zero_copy_only=False)[:, None] & ((p >= least) | np.isnan(p))  # NaN is larger than all numbers
    bits = np.left_shift(1, np.nan_to_num(matrix(cand, "mcs")[0]).astype(np.int32), dtype=np.int32)
    return pa.array((met * bits).sum(axis=1, dtype=np.int32), mask=cand.is_null().to_numpy(zero_copy_only=False))


def offset_loop(step: float = 0.25, target: float = 0.1, initial: float = 0.0) -> Machine:
    """Running CQI offset: up by step x target after a success, down by step x (1 - target) after a failure.

    The state is the number of failures so far; with the row index it fixes the offset exactly.
    """
    up = step * target

    def offset(index, failures):
        return initial + up * index - step * failures

    def summarize(inputs, n0):
        cqi, mask = inputs[0].astype(float), inputs[1].astype(np.int64)
        n = len(cqi)
        top = MCS_MAX + 1 - min(cqi.min(), 0.0) + n * step
        bottom = -1 - max(cqi.max(), 0.0) - n * step
        now = initial + up * n0
        low = max(0, int(np.ceil((now - top) / step)) - 1)
        high = min(n0, int(np.floor((now - bottom) / step)) + 1)
        low, high = min(low, n0), max(high, 0)
        low = min(low, high)
        states = np.arange(low, high + 1, dtype=np.int64)
        lanes, back = states.copy(), None
        for i in range(n):
            mcs = np.clip(np.rint(cqi[i] + offset(n0 + i, lanes)), 0, MCS_MAX).astype(np.int64)
            lanes = lanes + 1 - ((mask[i] >> mcs) & 1)
            if i % 64 == 63:
                merged, index = np.unique(lanes, return_inverse=True)
                if len(merged) < len(lanes):
                    lanes, back = merged, index if back is None else index[back]
        outs = lanes if back is None else lanes[back]
        pieces = _pieces(states, outs)
        fail_top = int((1 - ((mask >> MCS_MAX) & 1)).sum())
        fail_bottom = int((1 - (mask & 1)).sum())
        # Offsets outside the lanes stay saturated for the whole block.
        ends = []
        if high < n0:
            ends = [(high + 1, high + 1 + fail_bottom, 1)]
        front = [(0, fail_top, 1)] if low > 0 else []
        return front + pieces + ends

    def run(inputs, n0, state):
        cqi, mask = inputs[0].tolist(), inputs[1].tolist()
        out = np.empty(len(cqi), dtype=np.int32)
        failures = state
        for i, (c, bits) in enumerate(zip(cqi, mask)):
            mcs = min(max(round(c + offset(n0 + i, failures)), 0), MCS_MAX)
            out[i] = mcs
            failures += 1 - ((bits >> mcs) & 1)
        return out

    return Machine(("cqi", "_mask"), 0, summarize, run)


def olla(df: DataFrame, series, order, step: float = 0.25, target: float = 0.1, initial: float = 0.0,
         draw: Column | None = None, cand: str = "cand", out: str = "olla_mcs", block_rows: int = 20_000) -> DataFrame:
    """MCS chosen by the offset loop. Success means p >= 1 - target, or ``draw`` < p when a uniform column is given.

    The candidates of a row shrink to one bit per MCS before anything is shuffled; the array itself is dropped.
    """
    limit = F.lit(1.0 - target) if draw is None else draw
    # Stored, since a range partitioning reads its input twice.
    rows = materialize(df.withColumn("_mask", success_mask(limit, cand)).drop(cand), "masks")
    return replay(rows, series, order, offset_loop(step, target, initial), out, block_rows).drop("_mask")


# --- allocator gated by the block-error rate -------------------------------------------------------

ALLOCATOR_MAX = 15


def allocator_machine(target: float, initial: int = 1) -> Machine:
    """Index follows the report up, holds on a lower report, and resets when the error rate exceeds the target."""

    def step(cqi, bler, current):
        if bler > target:
            nxt = cqi
        elif bler < target and cqi > current:
            nxt = cqi
        elif bler < target and cqi < current:
            nxt = current
        elif bler == 0:
            nxt = cqi + 1
        else:
            nxt = cqi
        return min(max(nxt, 1), ALLOCATOR_MAX)

    def summarize(inputs, n0):
        cqi, bler = inputs[0].tolist(), inputs[1].tolist()
        states = list(range(0, ALLOCATOR_MAX + 1))
        for c, b in zip(cqi, bler):
            if b > target:
                states = [step(c, b, 0)] * len(states)
            else:
                states = [step(c, b, s) for s in states]
        return _pieces(np.arange(ALLOCATOR_MAX + 1), np.array(states))

    def run(inputs, n0, state):
        out = np.empty(len(inputs[0]), dtype=np.int32)
        for i, (c, b) in enumerate(zip(inputs[0].tolist(), inputs[1].tolist())):
            state = step(int(c), b, state)
            out[i] = state
        return out

    return Machine(("cqi", "bler"), initial, summarize, run)


def allocator(df: DataFrame, series, order, target: float, initial: int = 1, out: str = "alloc_cqi",
              block_rows: int = 20_000) -> DataFrame:
    """CQI index allocated per slot from reported ``cqi`` and running ``bler``; look it up in a CQI table next."""
    return replay(df, series, order, allocator_machine(target, initial), out, block_rows)
