"""Lookup tables: cells, builders, filling, nearest and exact lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radio
from ..functions.expr import code, linspace
from ..operators import isotonic, lut, metrics
from ..operators.candidates import candidates
from ..session import scratch_path, spread
from ..sources import luts, sinks
from .registry import query
from .tables import CAND, KEY_SQL, MCS, ROW_KEY, TX, p_sql, pass_probability, scored_contexts, table, transmissions

SNR_BIN = 0.1
MIN_CELL = 1


def _code(x, width="0.1"):
    return f"CAST(round_even(({x}) / {width}::DOUBLE, 0) AS BIGINT)"


CELLS = f"""
cells AS (
  SELECT {_code('snr')} AS snr_code, {_code('cqi', '1.0')} AS cqi_code, mcs, count(*) AS n, avg(label_pass) AS pass_rate,
    avg(tbs * label_pass) AS obs_tput
  FROM tx GROUP BY ALL HAVING count(*) >= {MIN_CELL})
"""

# Highest feasible MCS per cell, best pass rate as fallback.
EMPIRICAL = f"""{TX}, {CELLS},
emp AS (
  SELECT snr_code, cqi_code, coalesce(max(mcs) FILTER (pass_rate >= 0.6::DOUBLE), arg_max(mcs, (pass_rate, -mcs))) AS mcs
  FROM cells GROUP BY ALL)
"""


def _empirical(spark, sf_dir):
    return lut.empirical_lut(transmissions(spark, sf_dir), SNR_BIN, 1.0, MIN_CELL, threshold=0.6)


# Coarse part of the table, so lookups have to reach for neighbours.
COARSE = "lt AS (SELECT * FROM emp WHERE snr_code % 15 = 0 AND cqi_code % 3 = 0)"


def _coarse(spark, sf_dir):
    return _empirical(spark, sf_dir).where((F.col("snr_code") % 15 == 0) & (F.col("cqi_code") % 3 == 0))


@query("A22_cell_statistics", f"WITH {TX}, {CELLS} SELECT * FROM cells", "pass_rate obs_tput")
def cell_statistics(spark, sf_dir):
    return lut.cell_statistics(transmissions(spark, sf_dir), SNR_BIN, 1.0, MIN_CELL)


@query("A22_cell_statistics_by_efficiency", f"""WITH {TX}, {MCS}
SELECT {_code('snr')} AS snr_code, {_code('cqi', '1.0')} AS cqi_code, tx.mcs, count(*) AS n, avg(label_pass) AS pass_rate, avg(label_pass) * any_value(eff) AS obs_tput
FROM tx JOIN mcs_table m ON m.mcs = tx.mcs GROUP BY ALL HAVING count(*) >= 1""", "pass_rate obs_tput", digits=12)
def cell_statistics_by_efficiency(spark, sf_dir):
    return lut.cell_statistics(transmissions(spark, sf_dir).drop("tbs"), SNR_BIN, 1.0, 1)


_CELL_P = f"""{TX}, {CAND},
cp AS (
  SELECT {_code('snr')} AS snr_code, {_code('cqi', '1.0')} AS cqi_code, m AS mcs, count(*) AS n, avg(cp) AS p_stat, any_value(ceff) AS eff
  FROM cand GROUP BY ALL HAVING count(*) >= 5)
"""


def _varied(spark, sf_dir):
    """Candidates whose probability also depends on the elevation, so that cells hold different values."""
    tx = spread(transmissions(spark, sf_dir))
    return candidates(tx, lambda m: pass_probability(F.col("snr") + F.col("ele_angle") / 45, m))


_VARIED_CAND = f"""{TX}, {MCS},
vc AS (SELECT {_code('t.snr')} AS snr_code, {_code('t.cqi', '1.0')} AS cqi_code, m.mcs, m.eff,
  {p_sql('(t.snr + t.ele_angle / 45)', 'm.mcs')} AS cp FROM tx t CROSS JOIN mcs_table m)
"""


@query("A23_cell_probability_mean", f"""WITH {_VARIED_CAND} SELECT snr_code, cqi_code, mcs, count(*) AS n, avg(cp) AS p_stat FROM vc GROUP BY ALL HAVING count(*) >= 5""", "p_stat")
def cell_probability_mean(spark, sf_dir):
    return lut.cell_probability(_varied(spark, sf_dir), SNR_BIN, 1.0, 5)


@query("A23_cell_probability_quantile", f"""WITH {_VARIED_CAND} SELECT snr_code, cqi_code, mcs, count(*) AS n, quantile_cont(cp, 0.1) AS p_stat FROM vc GROUP BY ALL HAVING count(*) >= 5""", "p_stat", digits=7)
def cell_probability_quantile(spark, sf_dir):
    return lut.cell_probability(_varied(spark, sf_dir), SNR_BIN, 1.0, 5, 0.1)


def _pick_sql(expr, source="cells"):
    return f"SELECT snr_code, cqi_code, {expr} AS mcs FROM {source} GROUP BY ALL"


@query("W10_select_highest", f"WITH {EMPIRICAL} SELECT * FROM emp")
def select_highest(spark, sf_dir):
    return _empirical(spark, sf_dir)


@query("W10_select_lowest", f"WITH {TX}, {CELLS} {_pick_sql('coalesce(min(mcs) FILTER (pass_rate >= 0.65::DOUBLE), arg_max(mcs, (pass_rate, -mcs)))')}")
def select_lowest(spark, sf_dir):
    cells = lut.cell_statistics(transmissions(spark, sf_dir), SNR_BIN, 1.0, MIN_CELL)
    return lut.select_mcs(cells, "threshold", 0.6, "lowest_feasible", 0.05)


@query("W10_select_max_prob", f"WITH {TX}, {CELLS} {_pick_sql('coalesce(arg_max(mcs, (pass_rate, -mcs)) FILTER (pass_rate >= 0.6::DOUBLE), arg_max(mcs, (pass_rate, -mcs)))')}")
def select_max_prob(spark, sf_dir):
    cells = lut.cell_statistics(transmissions(spark, sf_dir), SNR_BIN, 1.0, MIN_CELL)
    return lut.select_mcs(cells, "threshold", 0.6, "max_prob_feasible")


@query("L1_empirical_lut_throughput", f"WITH {TX}, {CELLS} {_pick_sql('arg_max(mcs, (obs_tput, -mcs))')}")
def empirical_throughput(spark, sf_dir):
    return lut.empirical_lut(transmissions(spark, sf_dir), SNR_BIN, 1.0, MIN_CELL, objective="throughput")


@query("L1_empirical_lut_guarded", f"WITH {TX}, {CELLS} {_pick_sql('coalesce(arg_max(mcs, (obs_tput, -mcs)) FILTER (pass_rate >= 0.5), arg_max(mcs, (pass_rate, -mcs)))')}")
def empirical_guarded(spark, sf_dir):
    return lut.empirical_lut(transmissions(spark, sf_dir), SNR_BIN, 1.0, MIN_CELL, objective="throughput", guardrail=0.5)


_FILLED = """grid AS (SELECT DISTINCT snr_code, CAST(c.v AS BIGINT) AS cqi_code FROM lt, range(0, 16) c(v)),
near AS (SELECT g.snr_code, g.cqi_code, lt.mcs, row_number() OVER (PARTITION BY g.snr_code, g.cqi_code ORDER BY abs(g.cqi_code - lt.cqi_code), lt.cqi_code) AS rn
  FROM grid g JOIN lt ON lt.snr_code = g.snr_code)"""


@query("U4_fill_cqi_grid", f"WITH {EMPIRICAL}, {COARSE}, {_FILLED} SELECT snr_code, cqi_code, mcs FROM near WHERE rn = 1")
def fill_grid(spark, sf_dir):
    return lut.fill_cqi_grid(_coarse(spark, sf_dir))


@query("L1_empirical_lut_filled", f"WITH {EMPIRICAL}, lt AS (SELECT * FROM emp), {_FILLED} SELECT round(snr_code * 0.1::DOUBLE, 6) AS snr, round(cqi_code * 1.0::DOUBLE, 6) AS cqi, mcs FROM near WHERE rn = 1")
def empirical_filled(spark, sf_dir):
    filled = lut.empirical_lut(transmissions(spark, sf_dir), SNR_BIN, 1.0, MIN_CELL, (0, 15), threshold=0.6)
    return lut.decoded(filled)


@query("L2_model_lut", f"""WITH {_CELL_P} SELECT snr_code, cqi_code, CAST(least(greatest(coalesce(max(mcs) FILTER (p_stat >= 0.9::DOUBLE), arg_max(mcs, (p_stat, -mcs))), 2), 20) AS INTEGER) AS mcs
FROM cp GROUP BY ALL""")
def model_lut(spark, sf_dir):
    return lut.model_lut(scored_contexts(spark, sf_dir, "snr", "cqi"), SNR_BIN, 1.0, 5, mcs_min=2, mcs_max=20, threshold=0.9, weight="n")


@query("L2_model_lut_throughput", f"""WITH {_CELL_P} SELECT snr_code, cqi_code, coalesce(arg_max(mcs, (p_stat * eff, -mcs)) FILTER (p_stat >= 0.5), arg_max(mcs, (p_stat, -mcs))) AS mcs
FROM cp GROUP BY ALL""")
def model_lut_throughput(spark, sf_dir):
    return lut.model_lut(scored_contexts(spark, sf_dir, "snr", "cqi"), SNR_BIN, 1.0, 5, objective="throughput", guardrail=0.5, weight="n")


@query("U2_keyed_dedup", f"WITH {EMPIRICAL}, {COARSE} SELECT snr_code, cqi_code, mcs FROM lt UNION ALL SELECT snr_code, cqi_code, 0 FROM emp WHERE NOT (snr_code % 15 = 0 AND cqi_code % 3 = 0)")
def keyed_dedup(spark, sf_dir):
    return lut.merge_luts(_coarse(spark, sf_dir), _empirical(spark, sf_dir).withColumn("mcs", F.lit(0)))


# The SNR grid of the given tables, for the SQL twin: -9.5 to 15 in half steps. The query takes what the table has.
_SNR_CODES = list(range(-95, 151, 5))


@query("A20_lut_pivot", f"WITH {EMPIRICAL} SELECT cqi_code, " + ", ".join(f'avg(mcs) FILTER (snr_code = {c}) AS "{c}"' for c in _SNR_CODES) + " FROM emp GROUP BY 1")
def lut_pivot(spark, sf_dir):
    return metrics.lut_pivot(_empirical(spark, sf_dir), "cqi_code", "snr_code")


@query("S14_snr_lut_reader", f"WITH {EMPIRICAL} SELECT snr_code, max(mcs) AS mcs FROM emp GROUP BY 1")
def snr_lut_reader(spark, sf_dir):
    path = scratch_path(spark, "snr-lut")
    best = _empirical(spark, sf_dir).groupBy("snr_code").agg(F.max("mcs").alias("MCS"))
    sinks.write_small_csv(best.select((F.col("snr_code") / 10).alias("snr_bin"), "MCS"), path, ["snr_bin"])
    return luts.read_snr_lut(spark, path)


@query("S14_lut_reader", f"WITH {EMPIRICAL} SELECT * FROM emp")
def lut_reader(spark, sf_dir):
    path = scratch_path(spark, "lut")
    rows = lut.decoded(_empirical(spark, sf_dir)).select(F.col("snr").alias("SNR"), F.col("cqi").alias("Cqi"), F.col("mcs").alias("MCS"))
    sinks.write_small_csv(rows, path, ["SNR", "Cqi"])
    return luts.read_snr_cqi_lut(spark, path)


@query("S14_last_duplicate", """SELECT CAST(round_even(l_quantity / 0.5, 0) AS BIGINT) AS snr_code, arg_max(l_linenumber, (l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS mcs FROM lineitem GROUP BY 1""")
def last_duplicate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("snr"), F.col("l_linenumber").alias("mcs"), "l_orderkey", "l_partkey", "l_suppkey",
        F.col("l_linenumber").alias("line"),
    )
    return luts.lut_from_rows(li, ["l_orderkey", "l_partkey", "l_suppkey", "line"], 0.5, None)


@query("L4_P18_filter_lut", f"""WITH {TX} SELECT snr, CAST(round_even(ele_angle / 6, 0) AS INTEGER) AS cqi, least(greatest(mcs, 2), 15) AS mcs FROM tx""")
def filter_lut(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select("snr", (F.col("ele_angle") / 6).alias("cqi"), "mcs")
    return luts.filter_lut(tx, 2, 15)


@query("P18_round_snr", "SELECT l_orderkey, round_even(l_extendedprice / 777 * 10, 0) / 10 AS snr FROM lineitem")
def round_snr(spark, sf_dir):
    return luts.round_snr(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 777).alias("snr")))


# --- lookups ---------------------------------------------------------------------------------------

@query("J9_nearest_snr", f"""WITH {EMPIRICAL}, k AS (SELECT snr_code, max(mcs) AS mcs FROM emp WHERE snr_code % 15 = 0 GROUP BY 1),
c AS (SELECT DISTINCT {_code('ele_angle - 20')} AS code FROM tx),
near AS (SELECT c.code, k.mcs, row_number() OVER (PARTITION BY c.code ORDER BY abs(c.code - k.snr_code), k.snr_code) AS rn FROM c, k)
SELECT {KEY_SQL}, near.mcs AS lut_mcs FROM tx JOIN near ON near.code = {_code('ele_angle - 20')} AND rn = 1""")
def nearest_snr(spark, sf_dir):
    keys = _empirical(spark, sf_dir).where(F.col("snr_code") % 15 == 0).groupBy("snr_code").agg(F.max("mcs").alias("mcs"))
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, (F.col("ele_angle") - 20).alias("snr"))
    return lut.lookup_snr(tx, keys).drop("snr")


NEAREST_2D = f"""{EMPIRICAL}, {COARSE},
c AS (SELECT DISTINCT {_code('snr')} AS s, cqi AS c FROM tx),
ns AS (SELECT s, c, snr_code FROM (SELECT c.s, c.c, k.snr_code, row_number() OVER (PARTITION BY c.s, c.c ORDER BY abs(c.s - k.snr_code), k.snr_code) AS rn
  FROM c, (SELECT DISTINCT snr_code FROM lt) k) WHERE rn = 1),
nc AS (SELECT s, c, mcs FROM (SELECT ns.s, ns.c, lt.mcs, row_number() OVER (PARTITION BY ns.s, ns.c ORDER BY abs(ns.c - lt.cqi_code), lt.cqi_code) AS rn
  FROM ns JOIN lt ON lt.snr_code = ns.snr_code) WHERE rn = 1)
"""


@query("J10_nearest_snr_cqi", f"WITH {NEAREST_2D} SELECT {KEY_SQL}, nc.mcs AS lut_mcs FROM tx JOIN nc ON nc.s = {_code('snr')} AND nc.c = tx.cqi")
def nearest_snr_cqi(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, "snr", "cqi")
    return lut.lookup_snr_cqi(tx, _coarse(spark, sf_dir)).drop("snr", "cqi")


@query("J11_exact_lookup", f"""WITH {EMPIRICAL}, {COARSE} SELECT {KEY_SQL}, least(coalesce(lt.mcs, 0), 15) AS lut_cqi
FROM tx LEFT JOIN lt ON lt.snr_code = {_code('tx.snr')} AND lt.cqi_code = tx.cqi""")
def exact_lookup(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, "snr", "cqi")
    return lut.lookup_exact(tx, _coarse(spark, sf_dir)).drop("snr", "cqi")


_CQI1 = ", ".join(f"({cqi}, {qm}, {rate}, {eff}::DOUBLE, '{radio.MODULATION[qm]}')" for cqi, (qm, rate, eff) in enumerate(radio.CQI_TABLES["table1"], start=1))


@query("R10_lut_allocator", f"""WITH {EMPIRICAL}, {COARSE}, ct(cqi, qm, rate_x1024, efficiency, modulation) AS (VALUES {_CQI1}),
a AS (SELECT {KEY_SQL}, least(coalesce(lt.mcs, 0), 15) AS lut_cqi FROM tx LEFT JOIN lt ON lt.snr_code = {_code('tx.snr')} AND lt.cqi_code = tx.cqi)
SELECT {KEY_SQL}, lut_cqi, ct.qm, ct.rate_x1024, ct.efficiency, ct.modulation FROM a JOIN ct ON ct.cqi = greatest(lut_cqi, 1)""")
def lut_allocator(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, "snr", "cqi")
    chosen = lut.lookup_exact(tx, _coarse(spark, sf_dir)).drop("snr", "cqi")
    return radio.with_cqi_entry(chosen, "lut_cqi", "table1")


@query("M4_monotone_lut", f"""WITH {EMPIRICAL}, a AS (SELECT snr_code, cqi_code, max(mcs) OVER (PARTITION BY cqi_code ORDER BY snr_code) AS m FROM emp)
SELECT snr_code, cqi_code, max(m) OVER (PARTITION BY snr_code ORDER BY cqi_code) AS mcs FROM a""")
def monotone_lut(spark, sf_dir):
    return lut.monotone(_empirical(spark, sf_dir))


# Least squares by the formula of the least over the left ends of the largest mean over the right ends.
@query("M4_isotonic_pass_rate", f"""WITH {TX}, c AS (SELECT {_code('snr')} AS snr_code, mcs, count(*) AS n, sum(label_pass) AS t FROM tx GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER w AS cn, sum(t) OVER w AS ct, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY snr_code ORDER BY mcs)),
m AS (SELECT a.snr_code, a.i AS a, b.i AS b, (b.ct - a.ct + a.t) / (b.cn - a.cn + a.n) AS mean FROM r a JOIN r b ON a.snr_code = b.snr_code AND a.i <= b.i),
x AS (SELECT r.snr_code, r.i, m.a, max(mean) AS most FROM r JOIN m ON r.snr_code = m.snr_code AND m.a <= r.i AND m.b >= r.i GROUP BY ALL),
f AS (SELECT snr_code, i, min(most) AS fit FROM x GROUP BY 1, 2)
SELECT snr_code, mcs, CAST(n AS DOUBLE) AS weight, fit FROM r JOIN f USING (snr_code, i)""")
def isotonic_pass_rate(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(code("snr", 0.1).alias("snr_code"), "mcs", "label_pass")
    return isotonic.isotonic_fit(tx, ["snr_code"], "mcs", "label_pass", increasing=False)


@query("M4_isotonic_grid")
def isotonic_grid(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(code("snr", 0.1).alias("snr_code"), F.col("cqi").alias("cqi_code"), "p")
    return isotonic.isotonic_grid(tx, "snr_code", "cqi_code", "p", tolerance=1e-6)


# --- polynomial tables -----------------------------------------------------------------------------

# A cubic of (snr, cqi) used as a given model.
CUBIC = {(0, 0): 6.5, (1, 0): 0.4, (0, 1): 0.2, (2, 0): 0.03, (1, 1): 0.01, (0, 3): 0.0005}


@query("L5_polynomial_lut", f"""WITH {TX}, b AS (SELECT min(snr) AS lo, max(snr) AS hi FROM tx),
g AS (SELECT lo + i * 0.7::DOUBLE AS snr, CAST(c AS DOUBLE) AS cqi FROM b, range(0, CAST(ceil((hi + 0.35::DOUBLE - lo) / 0.7::DOUBLE) AS BIGINT)) r(i), range(0, 11) q(c))
SELECT snr, cqi, CAST(least(greatest(round_even(6.5 + 0.4 * snr + 0.2 * cqi + 0.03 * snr * snr + 0.01 * snr * cqi + 0.0005 * cqi * cqi * cqi, 0), 0), 27) AS INTEGER) AS mcs FROM g""", "snr")
def polynomial_lut(spark, sf_dir):
    low, high = transmissions(spark, sf_dir).agg(F.min("snr"), F.max("snr")).first()
    grid = lut.step_grid(spark, {"snr": (low, high, 0.7), "cqi": (0.0, 10.0, 1.0)})
    return lut.polynomial_lut(grid, lut.polynomial(CUBIC, ["snr", "cqi"]))


def _axes(spark, sf_dir):
    row = transmissions(spark, sf_dir).agg(F.min("snr"), F.max("snr"), F.min("cqi"), F.max("cqi")).first()
    return {"snr": linspace(row[0], row[1], 5), "cqi": linspace(row[2], row[3], 5)}, [row[1] - row[0], float(row[3] - row[2])]


_NEAREST = f"""b AS (SELECT min(snr) AS s0, max(snr) AS s1, min(cqi) AS c0, max(cqi) AS c1 FROM tx),
v AS (SELECT CAST(i * 5 + j AS INTEGER) AS vertex, i, j, s0 + (s1 - s0) / 4 * i AS vs, c0 + (c1 - c0) / 4 * j AS vc, s1 - s0 AS ws, c1 - c0 AS wc FROM b, range(0, 5) r(i), range(0, 5) q(j)),
d AS (SELECT vertex, mcs, sqrt(((snr - vs) / ws) ** 2 + ((cqi - vc) / wc) ** 2) AS d, {KEY_SQL} FROM tx, v),
r AS (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY d, {KEY_SQL}) AS rn FROM d),
k AS (SELECT vertex, sum(mcs / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS value, count(*) AS neighbours FROM r WHERE rn <= 200 GROUP BY 1)"""


@query("J15_nearest_rows", f"WITH {TX}, {_NEAREST} SELECT * FROM k", "value", digits=4)
def nearest_rows(spark, sf_dir):
    axes, scales = _axes(spark, sf_dir)
    return lut.nearest_rows(transmissions(spark, sf_dir), ["snr", "cqi"], "mcs", axes, scales, ROW_KEY, 200)


@query("L6_interpolation_lut", f"""WITH {TX}, {_NEAREST},
g AS (SELECT s0 + 0.5::DOUBLE * n AS snr, CAST(c0 + m AS DOUBLE) AS cqi FROM b, range(0, CAST(ceil((s1 + 0.25 - s0) / 0.5) AS BIGINT)) x(n), range(0, CAST(ceil(c1 + 0.5 - c0) AS BIGINT)) y(m)),
n AS (SELECT i, s0 + (s1 - s0) / 4 * i AS s, c0 + (c1 - c0) / 4 * i AS c FROM b, range(0, 5) r(i)),
ls AS (SELECT snr, a.i, product((snr - o.s) / (a.s - o.s)) AS l FROM (SELECT DISTINCT snr FROM g), n a JOIN n o ON a.i <> o.i GROUP BY ALL),
lc AS (SELECT cqi, a.i AS j, product((cqi - o.c) / (a.c - o.c)) AS l FROM (SELECT DISTINCT cqi FROM g), n a JOIN n o ON a.i <> o.i GROUP BY ALL)
SELECT snr, cqi, CAST(least(greatest(round_even(sum(value * ls.l * lc.l), 0), 0), 27) AS INTEGER) AS mcs
FROM g JOIN ls USING (snr) JOIN lc USING (cqi) JOIN v ON v.i = ls.i AND v.j = lc.j JOIN k USING (vertex) GROUP BY snr, cqi""")
def interpolation_lut(spark, sf_dir):
    axes, scales = _axes(spark, sf_dir)
    values = lut.nearest_rows(transmissions(spark, sf_dir), ["snr", "cqi"], "mcs", axes, scales, ROW_KEY, 200)
    # One value per vertex of a grid of at most a few nodes per axis.
    by_vertex = {r["vertex"]: r["value"] for r in values.collect()}
    vertices = {index: by_vertex[i] for i, (index, _) in enumerate(lut.grid_vertices(axes))}
    grid = lut.step_grid(spark, {n: (a[0], a[-1], 0.5 if n == "snr" else 1.0) for n, a in axes.items()})
    return lut.polynomial_lut(grid, lut.interpolate(vertices, axes))

