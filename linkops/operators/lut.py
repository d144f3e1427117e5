"""Building, filling and looking up (SNR, CQI) to MCS tables. Keys are integer grid codes throughout."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, code, decode, weighted_mean
from ..functions.radio import efficiency_column
from ..session import materialize, small_side
from .quantiles import ArrayValues, grouped_quantiles

CELL = ["snr_code", "cqi_code"]
RULES = ("highest_feasible", "max_prob_feasible", "lowest_feasible")


def densify(lut: DataFrame, key: str, parts=(), low=None, high=None) -> DataFrame:
    """Give every integer key between the first and last one (or ``low``..``high``) its nearest row; ties go down."""
    values = [c for c in lut.columns if c != key and c not in parts]
    w = Window.partitionBy(*parts).orderBy(key)
    here, after = F.struct(*values), F.lead(F.struct(*values)).over(w)
    rows = lut.select(
        *parts, F.col(key).alias("_k"), here.alias("_here"), after.alias("_after"),
        F.lag(key).over(w).alias("_prev"), F.lead(key).over(w).alias("_next"),
    )
    first = F.when(F.col("_prev").isNull() & F.lit(low is not None), F.least(F.col("_k"), _long(low, "_k"))).otherwise(F.col("_k"))
    last = F.when(
        F.col("_next").isNull(),
        F.greatest(F.col("_k"), _long(high, "_k")) if high is not None else F.col("_k"),
    ).otherwise(F.col("_next") - 1)
    filled = rows.withColumn(key, F.explode(F.sequence(first, last)))
    up = F.col("_next").isNotNull() & ((F.col("_next") - F.col(key)) < (F.col(key) - F.col("_k")))
    return filled.select(*parts, key, F.when(up, F.col("_after")).otherwise(F.col("_here")).alias("_v")).select(
        *parts, key, "_v.*"
    )


def _long(value, key: str) -> Column:
    return F.lit(value).cast("bigint") if value is not None else F.col(key)


def lookup_snr(df: DataFrame, lut: DataFrame, snr: str = "snr", snr_bin: float = 0.1, default: int = 0,
               out: str = "lut_mcs") -> DataFrame:
    """Nearest key of a 1-D table ``(snr_code, mcs)``; an empty table gives ``default``."""
    lut = materialize(lut.select("snr_code", "mcs"), "lut")
    dense = densify(lut, "snr_code").select(
        F.col("snr_code").alias("_s"), F.col("mcs").alias("_mcs")
    )
    span = lut.agg(F.min("snr_code").alias("_lo"), F.max("snr_code").alias("_hi"))
    keyed = df.join(F.broadcast(span)).withColumn("_s", clip_col(code(snr, snr_bin), "_lo", "_hi"))
    joined = keyed.join(small_side(dense), "_s", "left")
    return joined.withColumn(out, F.coalesce("_mcs", F.lit(default))).drop("_s", "_mcs", "_lo", "_hi")


def clip_col(value: Column, low: str, high: str) -> Column:
    return clip(value, F.col(low), F.col(high))


def dense_table(lut: DataFrame) -> DataFrame:
    """2-D table filled along CQI inside each SNR, then along SNR: one row per code pair."""
    # A lookup table has one cell per grid code, so its CQI span is read as two numbers.
    span = lut.agg(F.min("cqi_code"), F.max("cqi_code")).first()
    if span[0] is None:
        return lut.select(*CELL, "mcs")
    by_cqi = densify(lut.select(*CELL, "mcs"), "cqi_code", ["snr_code"], span[0], span[1])
    packed = by_cqi.groupBy("snr_code").agg(F.sort_array(F.collect_list(F.struct("cqi_code", "mcs"))).alias("row"))
    return densify(packed, "snr_code").select("snr_code", F.inline("row"))


def lookup_snr_cqi(df: DataFrame, lut: DataFrame, snr: str = "snr", cqi: str = "cqi", snr_bin: float = 0.1,
                   cqi_bin: float = 1.0, default: int = 0, out: str = "lut_mcs") -> DataFrame:
    """Nearest SNR key, then nearest CQI key inside it; one equality join on the filled table."""
    lut = materialize(lut.select(*CELL, "mcs"), "lut")
    dense = materialize(dense_table(lut), "dense-lut").select(F.col("snr_code").alias("_s"), F.col("cqi_code").alias("_c"), F.col("mcs").alias("_mcs"))
    span = lut.agg(
        F.min("snr_code").alias("_slo"), F.max("snr_code").alias("_shi"),
        F.min("cqi_code").alias("_clo"), F.max("cqi_code").alias("_chi"),
    )
    keyed = df.join(F.broadcast(span)).withColumns({
        "_s": clip_col(code(snr, snr_bin), "_slo", "_shi"), "_c": clip_col(code(cqi, cqi_bin), "_clo", "_chi"),
    })
    joined = keyed.join(small_side(dense), ["_s", "_c"], "left")
    return joined.withColumn(out, F.coalesce("_mcs", F.lit(default))).drop(
        "_s", "_c", "_mcs", "_slo", "_shi", "_clo", "_chi"
    )


def lookup_exact(df: DataFrame, lut: DataFrame, snr: str = "snr", cqi: str = "cqi", cap: int = 15,
                 out: str = "lut_cqi") -> DataFrame:
    """Exact hit on SNR (1 digit) and CQI: value capped at ``cap``; a miss gives 0."""
    keys = materialize(lut.select(F.col("snr_code").alias("_s"), F.col("cqi_code").alias("_c"), F.col("mcs").alias("_mcs")), "lut")
    keyed = df.withColumns({"_s": code(snr, 0.1), "_c": code(cqi, 1.0)})
    joined = keyed.join(small_side(keys), ["_s", "_c"], "left")
    return joined.withColumn(out, F.least(F.coalesce("_mcs", F.lit(0)), F.lit(cap))).drop("_s", "_c", "_mcs")


def fill_cqi_grid(lut: DataFrame, cqi_min: int = 0, cqi_max: int = 15) -> DataFrame:
    """Every CQI code of the grid per SNR, from the nearest present CQI (ties go down); real rows stay as they are."""
    real = lut.select(*CELL, "mcs")
    dense = densify(real, "cqi_code", ["snr_code"], cqi_min, cqi_max)
    inside = dense.where(F.col("cqi_code").between(cqi_min, cqi_max))
    outside = real.where(~F.col("cqi_code").between(cqi_min, cqi_max))
    return inside.unionByName(outside)


def merge_luts(*ranked: DataFrame) -> DataFrame:
    """Union of tables by key where the earlier table wins."""
    tagged = [t.select(*CELL, "mcs", F.lit(i).alias("_rank")) for i, t in enumerate(ranked)]
    merged = reduce(DataFrame.unionByName, tagged)
    return merged.groupBy(*CELL).agg(F.min_by("mcs", "_rank").alias("mcs"))


def decoded(lut: DataFrame, snr_bin: float = 0.1, cqi_bin: float = 1.0) -> DataFrame:
    """Output form ``snr, cqi, mcs`` with clean keys."""
    return lut.select(decode("snr_code", snr_bin).alias("snr"), decode("cqi_code", cqi_bin).alias("cqi"), "mcs")


def cell_statistics(df: DataFrame, snr_bin: float = 0.1, cqi_bin: float = 1.0, min_count: int = 50) -> DataFrame:
    """Rows, pass rate and delivered bytes (or pass rate x efficiency) per (SNR, CQI, MCS) cell."""
    label = F.col("label_pass").cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(label).alias("pass_rate")]
    if "tbs" in df.columns:
        aggs.append(F.avg(F.col("tbs") * label).alias("obs_tput"))
    cells = (
        df.groupBy(code("snr", snr_bin).alias("snr_code"), code("cqi", cqi_bin).alias("cqi_code"), "mcs")
        .agg(*aggs).where(F.col("n") >= min_count)
    )
    if "tbs" not in df.columns:
        cells = cells.withColumn("obs_tput", F.col("pass_rate") * efficiency_column("mcs"))
    return cells


def select_mcs(cells: DataFrame, objective: str = "threshold", threshold: float = 0.9, rule: str = "highest_feasible",
               margin: float = 0.0, guardrail: float | None = None, rate: str = "pass_rate",
               score: str = "obs_tput") -> DataFrame:
    """One MCS per (SNR, CQI) cell; all ties go to the lowest MCS, no feasible one to the best rate."""
    if rule not in RULES or objective not in ("threshold", "throughput"):
        raise ValueError((objective, rule))
    extra = max(0.0, margin)
    low_first = -F.col("mcs")
    best_rate = F.max_by("mcs", F.struct(F.col(rate), low_first))
    if objective == "throughput" and (guardrail is None or guardrail < 0):
        pick = F.max_by("mcs", F.struct(F.col(score), low_first))
    else:
        required = (threshold if objective == "threshold" else guardrail) + extra
        ok = F.col(rate) >= F.lit(float(required))
        mcs = F.when(ok, F.col("mcs"))
        if rule == "lowest_feasible":
            chosen = F.min(mcs)
        elif rule == "max_prob_feasible":
            chosen = F.max_by("mcs", F.when(ok, F.struct(F.col(rate), low_first)))
        elif objective == "threshold":
            chosen = F.max(mcs)
        else:
            chosen = F.max_by("mcs", F.when(ok, F.struct(F.col(score), low_first)))
        pick = F.coalesce(chosen, best_rate)
    return cells.groupBy(*CELL).agg(pick.alias("mcs"))


def empirical_lut(df: DataFrame, snr_bin: float = 0.1, cqi_bin: float = 1.0, min_count: int = 50,
                  fill: tuple[int, int] | None = None, **rule) -> DataFrame:
    """Table from logged outcomes; ``rule`` goes to :func:`select_mcs`, ``fill`` completes the CQI grid."""
    lut = select_mcs(cell_statistics(df, snr_bin, cqi_bin, min_count), **rule)
    return fill_cqi_grid(lut, *fill) if fill else lut


def cell_probability(df: DataFrame, snr_bin: float = 0.1, cqi_bin: float = 1.0, min_count: int = 500,
                     quantile: float | None = None, cand: str = "cand", weight: str | None = None) -> DataFrame:
    """Mean, or exact quantile, of the pass probability per (SNR, CQI, MCS); cells need ``min_count`` rows.

    With ``weight`` a row stands for so many equal ones; quantiles need plain rows.
    """
    if weight and quantile is not None and quantile >= 0:
        raise ValueError("quantiles need plain rows")
    times = F.col(weight) if weight else F.lit(1).cast("bigint")
    keyed = df.select(code("snr", snr_bin).alias("snr_code"), code("cqi", cqi_bin).alias("cqi_code"), times.alias("_w"), cand)
    # Candidates are expanded in place and summed on the map side: one partial row per cell and MCS is shuffled.
    rows = keyed.select(*CELL, "_w", F.inline(cand)).withColumnRenamed("p", "p_stat")
    if quantile is None or quantile < 0:
        means = rows.groupBy(*CELL, "mcs").agg(F.sum("_w").alias("n"), weighted_mean("p_stat", "_w").alias("p_stat"))
        long = means.where(F.col("n") >= min_count).select(*CELL, "n", "mcs", "p_stat")
    else:
        sizes = keyed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
        values = ArrayValues(keyed, CELL, cand, "mcs", "p")
        ranked = grouped_quantiles(values, [*CELL, "mcs"], "p_stat", [quantile], "linear").drop("q")
        long = ranked.join(sizes, CELL).select(*CELL, "n", "mcs", "p_stat")
    return long


def model_lut(df: DataFrame, snr_bin: float = 0.1, cqi_bin: float = 1.0, min_count: int = 500,
              quantile: float | None = None, mcs_min: int = 0, mcs_max: int = 27,
              fill: tuple[int, int] | None = None, cand: str = "cand", weight: str | None = None, **rule) -> DataFrame:
    """Table from scored candidates; the choice is clamped to the allowed range."""
    cells = cell_probability(df, snr_bin, cqi_bin, min_count, quantile, cand, weight)
    scored = cells.withColumn("expected", F.col("p_stat") * efficiency_column("mcs"))
    lut = select_mcs(scored, rate="p_stat", score="expected", **rule)
    lut = lut.withColumn("mcs", clip("mcs", mcs_min, mcs_max).cast("int"))
    return fill_cqi_grid(lut, *fill) if fill else lut


def classifier_lut(df: DataFrame, classify, snr_bin: float = 0.1, cqi_bin: float = 1.0, min_count: int = 500,
                   fill: tuple[int, int] | None = None) -> DataFrame:
    """Table from a classifier: ``classify`` adds ``mcs`` to a frame of bin values ``snr, cqi``."""
    bins = (
        df.groupBy(code("snr", snr_bin).alias("snr_code"), code("cqi", cqi_bin).alias("cqi_code"))
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
        .withColumns({"snr": decode("snr_code", snr_bin), "cqi": decode("cqi_code", cqi_bin)})
    )
    lut = classify(bins).select(*CELL, F.col("mcs").cast("int").alias("mcs"))
    return fill_cqi_grid(lut, *fill) if fill else lut


def monotone(lut: DataFrame) -> DataFrame:
    """Raise entries so that MCS never falls with SNR (inside a CQI) or with CQI (inside an SNR)."""
    def running(key, part):
        return Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)

    up = lut.withColumn("mcs", F.max("mcs").over(running("snr_code", "cqi_code")))
    return up.withColumn("mcs", F.max("mcs").over(running("cqi_code", "snr_code")))


# --- polynomial tables -----------------------------------------------------------------------------

def axis_points(low: float, high: float, step: float) -> int:
    """Points of an axis from ``low`` in steps, up to half a step beyond ``high``."""
    return max(0, math.ceil((high + step / 2 - low) / step))


def step_grid(spark: SparkSession, axes: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Grid of ``name: (low, high, step)`` axes, one range that is decoded into the axis values."""
    sizes = {name: axis_points(*spec) for name, spec in axes.items()}
    total = math.prod(sizes.values())
    grid, stride = spark.range(total), total
    for name, (low, _, step) in axes.items():
        stride //= sizes[name]
        index = F.pmod(F.floor(F.col("id") / F.lit(stride)), F.lit(sizes[name]))
        grid = grid.withColumn(name, F.lit(float(low)) + index * F.lit(float(step)))
    return grid.drop("id")


def polynomial(terms: dict[tuple[int, ...], float], columns) -> Column:
    """Sum of coefficient x powers as one column; ``terms`` maps exponents to coefficients."""
    total = F.lit(0.0)
    for exponents, coefficient in terms.items():
        product = F.lit(float(coefficient))
        for name, power in zip(columns, exponents):
            for _ in range(power):
                product = product * F.col(name)
        total = total + product
    return total


def polynomial_lut(grid: DataFrame, value: Column, mcs_min: int = 0, mcs_max: int = 27) -> DataFrame:
    return grid.withColumn("mcs", clip(F.rint(value).cast("int"), mcs_min, mcs_max))


def lagrange(name: str, nodes, index: int) -> Column:
    """Basis polynomial of one node of an axis."""
    product = F.lit(1.0)
    for j, other in enumerate(nodes):
        if j != index:
            product = product * ((F.col(name) - F.lit(float(other))) / F.lit(float(nodes[index] - other)))
    return product


def interpolate(vertices, axes: dict[str, list[float]]) -> Column:
    """Tensor interpolation polynomial through vertex values.

    ``vertices`` maps index tuples to values; axes hold at most a handful of nodes, so this is a fixed formula.
    """
    bases = {name: [lagrange(name, nodes, i) for i in range(len(nodes))] for name, nodes in axes.items()}
    total = F.lit(0.0)
    for index, value in vertices.items():
        product = F.lit(float(value))
        for (name, _), i in zip(axes.items(), index):
            product = product * bases[name][i]
        total = total + product
    return total


def grid_vertices(axes: dict[str, list[float]]):
    """Index tuples and coordinates of every vertex."""
    shapes = [range(len(nodes)) for nodes in axes.values()]
    for index in np.ndindex(*[len(s) for s in shapes]):
        yield index, [nodes[i] for nodes, i in zip(axes.values(), index)]


# Cells of the space partition behind ``nearest_rows``, over all axes together.
CELLS = 32_768


def nearest_cells(rows: DataFrame, features, cells, points, scales, k: int) -> DataFrame:
    """``vertex, <cells>`` of every cell that can hold one of the ``k`` rows nearest to a vertex.

    Of each cell only its number of rows and the range of its features are known. Cells are taken by their farthest
    corner until ``k`` rows are inside; no row farther than that corner counts, so no cell whose nearest corner is
    beyond it matters. Distances of corners round like those of rows, each step being monotone, so none is missed.
    """
    boxes = rows.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("_n"), *[g(f).alias(f"_{end}{i}") for i, f in enumerate(features) for end, g in (("lo", F.min), ("hi", F.max))],
    )
    entries = F.array(*[
        F.struct(F.lit(i).alias("vertex"), F.array(*[F.lit(float(x)) for x in point]).alias("at")) for i, point in enumerate(points)
    ])
    met = materialize(boxes, "cells").withColumn("_v", F.explode(entries))

    def corner(i: int, scale: float, pick) -> Column:
        at = F.element_at("_v.at", i + 1)
        below, above = _scaled(F.col(f"_lo{i}"), at, scale), _scaled(F.col(f"_hi{i}"), at, scale)
        return pick(below, above)

    inside = lambda a, b: F.when((a <= 0) & (b >= 0), 0.0).otherwise(F.least(F.abs(a), F.abs(b)))
    outside = lambda a, b: F.greatest(F.abs(a), F.abs(b))
    near = _length([corner(i, s, inside) for i, s in enumerate(scales)])
    far = _length([corner(i, s, outside) for i, s in enumerate(scales)])
    ranged = met.select(F.col("_v.vertex").alias("vertex"), *cells, "_n", near.alias("_near"), far.alias("_far"))
    closer = Window.partitionBy("vertex").orderBy("_far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    enough = ranged.withColumn("_upto", F.sum("_n").over(closer)).where(F.col("_upto") >= k)
    reach = enough.groupBy("vertex").agg(F.min("_far").alias("_reach"))  # one row per vertex
    return ranged.join(F.broadcast(reach), "vertex", "left").where(
        F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach"))
    ).select("vertex", *cells)


def _scaled(value: Column, at: Column, scale: float) -> Column:
    return (value - at) / F.lit(float(scale or 1.0))


def _length(sides: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [s ** 2 for s in sides]))


def nearest_rows(df: DataFrame, features, target: str, axes: dict[str, list[float]], scales, row_key,
                 k: int = 200, cells: int = CELLS) -> DataFrame:
    """Inverse-distance mean of ``target`` over the k rows nearest to each grid vertex.

    Rows are counted into the cells of a grid over the scaled features; a search over these cells names the few that
    can hold a neighbour of a vertex, and only their rows are looked at: as many as ``k`` asks for, whatever the
    number of rows and vertices. Ties go to the lowest key; a vertex with fewer than k rows has them all. Rows without
    a feature or the target take no part.
    """
    features, points = list(features), [point for _, point in grid_vertices(axes)]
    per_axis = max(1, int(cells ** (1 / len(features)) + 1e-9))
    ids = [f"_cell{i}" for i in range(len(features))]
    index = [
        F.least(F.greatest(F.floor(_scaled(F.col(f), F.lit(float(nodes[0])), s) * per_axis), F.lit(0)), F.lit(per_axis - 1)).cast("int").alias(c)
        for f, nodes, s, c in zip(features, axes.values(), scales, ids)
    ]
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], target, *row_key).dropna(subset=[*features, target])
    rows = rows.select("*", *index)
    wanted = materialize(nearest_cells(rows, features, ids, points, scales, k), "nearest-cells")
    # A cell is wanted by few vertices; they travel as a list, so a row is looked up once.
    at = F.array(*[F.array(*[F.lit(float(x)) for x in point]) for point in points])
    asked = wanted.groupBy(*ids).agg(F.collect_list("vertex").alias("_asked"))
    near = rows.join(small_side(materialize(asked, "asked-cells")), ids).withColumn("vertex", F.explode("_asked"))
    vertex = F.element_at(at, F.col("vertex") + 1)
    distance = _length([_scaled(F.col(f), F.element_at(vertex, i + 1), s) for i, (f, s) in enumerate(zip(features, scales))])
    measured = near.select("vertex", target, *row_key, distance.alias("_d"))
    rank = F.row_number().over(Window.partitionBy("vertex").orderBy("_d", *row_key))
    weight = 1 / (F.col("_d") + F.lit(1e-6))
    return measured.withColumn("_rank", rank).where(F.col("_rank") <= k).groupBy("vertex").agg(
        (F.sum(weight * F.col(target)) / F.sum(weight)).alias("value"), F.count(F.lit(1)).alias("neighbours")
    )
