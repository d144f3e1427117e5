"""Lookup tables, polynomial tables and fits."""

from linkops.functions import radio
from linkops.functions.expr import linspace
from linkops.operators import lut, modelling


def test_nearest_lookup_edges(spark):
    table = spark.createDataFrame([(-10, 1), (0, 5), (10, 9)], "snr_code bigint, mcs int")
    rows = spark.createDataFrame([(-5.0,), (-0.5,), (0.0,), (0.51,), (9.0,)], "snr double")
    got = {r.snr: r.lut_mcs for r in lut.lookup_snr(rows, table).collect()}
    assert got == {-5.0: 1, -0.5: 1, 0.0: 5, 0.51: 5, 9.0: 9}
    empty = lut.lookup_snr(rows, table.limit(0), default=4)
    assert {r.lut_mcs for r in empty.collect()} == {4}


def test_fill_is_rectangular_and_idempotent(spark):
    table = spark.createDataFrame([(1, 2, 3), (1, 6, 7), (2, 0, 1)], "snr_code bigint, cqi_code bigint, mcs int")
    once = lut.fill_cqi_grid(table)
    assert once.count() == 32
    assert sorted(map(tuple, lut.fill_cqi_grid(once).collect())) == sorted(map(tuple, once.collect()))
    row = {r.cqi_code: r.mcs for r in once.where("snr_code = 1").collect()}
    assert (row[0], row[4], row[5], row[15]) == (3, 3, 7, 7)


def test_interpolation_reproduces_a_polynomial(spark):
    axes = {"snr": linspace(-8.0, 4.0, 5), "cqi": linspace(0.0, 10.0, 5)}
    f = lambda s, c: 0.01 * s ** 4 - 0.2 * s * c + 0.003 * c ** 3 + 5
    vertices = {index: f(*point) for index, point in lut.grid_vertices(axes)}
    grid = lut.step_grid(spark, {"snr": (-8.0, 4.0, 0.5), "cqi": (0.0, 10.0, 1.0)})
    rows = grid.withColumn("v", lut.interpolate(vertices, axes)).collect()
    assert len(rows) == 25 * 11
    assert all(abs(r.v - f(r.snr, r.cqi)) < 1e-8 for r in rows)


def test_fit_recovers_a_cubic(spark):
    truth = {(0, 0): 6.7, (1, 0): 0.4, (2, 1): -0.004, (0, 3): 0.0006}
    grid = lut.step_grid(spark, {"snr": (-8.0, 4.0, 0.5), "cqi": (0.0, 10.0, 1.0)})
    df = grid.withColumn("y", lut.polynomial(truth, ["snr", "cqi"]))
    found = modelling.fit_polynomial(df, ["snr", "cqi"], "y", 3)
    for powers in modelling.exponents(2, 3):
        assert abs(found.get(powers, 0.0) - truth.get(powers, 0.0)) < 1e-8


def test_tables():
    assert len(radio.MCS_TABLE) == 28 and all(len(t) == 15 for t in radio.CQI_TABLES.values())
    assert radio.efficiency(99) == 0.0
