"""Null values stay null, and rows with null keys stay."""

import pytest
from pyspark.sql import functions as F


def test_clip_keeps_null(spark):
    from linkops.operators.features import derived_features

    rows = derived_features(spark.createDataFrame([(None,), (-30.0,), (1.0,)], "snr double")).orderBy("snr").collect()
    assert [r["snr_clip"] for r in rows] == [None, -20.0, 1.0]


def test_cqi_entry_of_null(spark):
    from linkops.functions.radio import with_cqi_entry

    rows = with_cqi_entry(spark.createDataFrame([(None,), (0,), (1,)], "cqi int")).collect()
    found = {r["cqi"]: r["qm"] for r in rows}
    assert found[None] is None and found[0] == found[1] == 2


def test_lookup_of_null_gives_the_default(spark):
    from linkops.operators.lut import lookup_snr, lookup_snr_cqi

    one = spark.createDataFrame([(0, 1), (50, 9)], "snr_code long, mcs int")
    got = {r["snr"]: r["lut_mcs"] for r in lookup_snr(spark.createDataFrame([(None,), (5.0,)], "snr double"), one, default=4).collect()}
    assert got == {None: 4, 5.0: 9}
    two = spark.createDataFrame([(0, 1, 1), (50, 1, 9)], "snr_code long, cqi_code long, mcs int")
    rows = spark.createDataFrame([(None, 1), (5.0, None), (5.0, 1)], "snr double, cqi int")
    got = {(r["snr"], r["cqi"]): r["lut_mcs"] for r in lookup_snr_cqi(rows, two, default=4).collect()}
    assert got == {(None, 1): 4, (5.0, None): 4, (5.0, 1): 9}


def test_null_probability_is_in_no_bin(spark):
    from linkops.operators.evaluate import reliability

    rows = spark.createDataFrame([(None, 1), (0.5, 1), (0.01, 0)], "p double, label_pass int")
    assert reliability(rows, 10).agg(F.sum("count")).first()[0] == 2


def test_null_strata_and_files_keep_their_rows(spark):
    from linkops.operators.metrics import relative_time
    from linkops.operators.sampling import exact_split

    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id int, s string")
    split = exact_split(rows, 0.2, ["id"], ["s"])
    assert split.count() == 20 and split.where("split = 'test'").count() == 4
    timed = spark.sql("SELECT timestamp'2025-01-01' AS ts, CAST(null AS string) AS file UNION ALL SELECT timestamp'2025-01-01 00:00:02', null")
    assert sorted(r["pdsch_time_relative_s"] for r in relative_time(timed).collect()) == [0.0, 2.0]


def test_null_groups_have_quantiles_and_running_sums(spark):
    from linkops.operators.ordered import running_sums
    from linkops.operators.quantiles import grouped_quantiles

    rows = spark.createDataFrame([(None, float(i)) for i in range(11)] + [("a", 1.0)], "k string, x double")
    got = {r["k"]: r["x"] for r in grouped_quantiles(rows, ["k"], "x", [0.5]).collect()}
    assert got == {None: 5.0, "a": 1.0}
    run = running_sums(rows, ["k"], ["x"], {"n": F.lit(1)}, chunks=4)
    assert run.where("k IS NULL").agg(F.max("n")).first()[0] == 11


def test_features_of_a_mixed_folder(spark, tmp_path):
    from linkops.plans.feature_flow import features_from_files

    (tmp_path / "a.csv").write_text("SNR,MCS,BLER,ack_result\n1.0,3,0.5,ACK\n")
    (tmp_path / "run_BLERw2000Tbler0.25_x.csv").write_text("SNR,MCS,BLER,BLKErr\n2.0,4,0.1,1\n")
    (tmp_path / "c.csv").write_text("SNR;MCS;BLER;BLKErr;window;Targetbler\n3.0;5;0.5;1;77;0.01\n")
    got = {r["source_file"]: r for r in features_from_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"]["target_bler"] == 10.0 and got["a.csv"]["blkerr"] == 1 and got["a.csv"]["label_pass"] == 1
    named = got["run_BLERw2000Tbler0.25_x.csv"]
    assert (named["window"], named["target_bler"], named["label_pass"]) == (2000.0, 0.25, 1)
    assert (got["c.csv"]["window"], got["c.csv"]["target_bler"], got["c.csv"]["label_pass"]) == (77.0, 0.01, 0)


def test_tabs_are_blanks(spark, tmp_path):
    from linkops.sources.logs import line_count, scan_log

    (tmp_path / "x.log").write_text("a\n \t \n\tb \n")
    lines = scan_log(spark, str(tmp_path))
    assert line_count(lines).first()["lines"] == 2 and {r["value"] for r in lines.collect()} == {"a", "b"}


@pytest.mark.parametrize("rows, width, kept", [(3, 8, True), (3, 100, False)])
def test_broadcasts_count_bytes(spark, rows, width, kept):
    from linkops.session import small_side

    df = spark.range(rows).select(F.repeat(F.lit("x"), width).alias("t"))
    plan = small_side(df, 10, 150)._jdf.queryExecution().logical().toString()
    assert ("broadcast" in plan) == kept
