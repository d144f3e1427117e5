"""Slot-table sources, row expressions, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radio
from ..operators import correlate, features, metrics, sampling
from ..plans import feature_flow
from ..session import scratch_path
from ..sources import sinks, slots
from .registry import query
from .tables import KEY_SQL, MCS, ROW_KEY, TX, table, transmissions


# --- sources and sinks -----------------------------------------------------------------------------

def _slot_files(spark, sf_dir):
    """Three kinds of slot files: comma, semicolon with alias headers, and a comma file named .tab."""
    tx = transmissions(spark, sf_dir)
    root = scratch_path(spark, "slots")
    quoted = F.concat(F.lit(" '"), F.col("snr").cast("string"), F.lit("' "))
    part = F.pmod("l_orderkey", F.lit(3))
    tx.where(part == 0).select(
        F.col("l_orderkey").alias("slot"), quoted.alias("SNR"), F.col("cqi").alias("CQI"), F.col("mcs").alias("MCS"),
        F.col("tbs").alias("TBS"), F.col("bler").alias("BLER"), F.col("target_bler").alias("Targetbler"),
        F.col("blkerr").alias("BLKErr"),
    ).write.option("header", "true").csv(f"{root}/a")
    tx.where(part == 1).select(
        F.col("l_orderkey").alias("nslot"), F.col("snr").alias("dl_sinr"), F.col("cqi").alias("dl_cqi"),
        F.col("mcs").alias("mcs_idx"), F.col("tbs").alias("tbs_bytes"), F.col("bler").alias("block_error_rate"),
        F.when(F.col("blkerr") == 1, "ack").otherwise("nack").alias("ack_result"),
    ).write.option("header", "true").option("sep", ";").csv(f"{root}/b")
    tx.where(part == 2).select(
        F.col("l_orderkey").alias("slot"), F.col("snr").alias("SNR"), F.col("cqi").alias("CQI"),
        F.when(F.col("mcs") == 3, "n/a").otherwise(F.col("mcs").cast("string")).alias("MCS"),
        F.col("tbs").alias("TBS"), F.col("bler").alias("BLER"), F.col("target_bler").alias("Targetbler"),
        F.col("blkerr").alias("BLKErr"),
    ).write.option("header", "true").csv(f"{root}/c")
    return root


@query("S6_S7_S8_slot_files", f"""WITH {TX}
SELECT l_orderkey AS slot, snr, cqi, CASE WHEN l_orderkey % 3 = 2 AND mcs = 3 THEN NULL ELSE mcs END AS mcs, CAST(tbs AS DOUBLE) AS tbs, bler,
  CASE WHEN l_orderkey % 3 = 1 THEN 10.0 ELSE target_bler END AS target_bler, blkerr,
  CASE WHEN l_orderkey % 3 = 1 THEN CAST(bler <= 10.0 AND blkerr = 1 AS INTEGER)
    ELSE CAST(bler <= target_bler AND blkerr = 1 AS INTEGER) END AS label_pass FROM tx""")
def slot_files(spark, sf_dir):
    """Detected delimiters, mixed folder scan and diagonal union, through to labels."""
    root = _slot_files(spark, sf_dir)

    def canonical(frame):
        # Each file kind is completed on its own, so a missing target falls back only there.
        return features.engineer(frame, int_via_double=True)

    raw = slots.scan_slot_files(spark, root, "*", rename=canonical)
    return raw.select("slot", "snr", "cqi", "mcs", "tbs", "bler", "target_bler", "blkerr", "label_pass")


@query("S6_delimiters", """SELECT * FROM (VALUES (',', 'csv', 'slot'), (';', 'csv', 'nslot')) AS v(sep, ext, first_column)""")
def delimiters(spark, sf_dir):
    found = slots.detect_delimiters(slots.list_files(spark, _slot_files(spark, sf_dir)), 8)
    first = F.element_at(F.split("header", "[,;]"), 1)
    return found.select("sep", "ext", first.alias("first_column")).distinct()


@query("S9_file_name_metadata", """SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 100 AS INTEGER) AS window_rows,
  CAST('0.' || (l_orderkey % 10) AS DOUBLE) AS target_bler FROM lineitem""")
def file_name_metadata(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    digit = F.pmod("l_orderkey", F.lit(10))
    # A target of 0 is written "0." in such names.
    tail = F.when(digit == 0, F.lit("0.csv")).otherwise(F.concat(F.lit("0."), digit.cast("string"), F.lit("_240603.csv")))
    name = F.concat(F.lit("run_Blerw"), (F.col("l_linenumber") * 100).cast("string"), F.lit("Tbler"), tail)
    return slots.file_name_metadata(
        li.select("l_orderkey", "l_linenumber", name.alias("source_file")), window="window_rows"
    ).drop("source_file")


@query("S10_scenario_metadata", """SELECT l_orderkey, l_linenumber, l_tax AS target_bler, CAST(l_linenumber * 10 AS INTEGER) AS bler_window,
  CAST(l_suppkey + 500 AS INTEGER) AS altitude_km, CAST(l_orderkey % 1000 AS INTEGER) AS seed FROM lineitem""")
def scenario_metadata(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    path = F.format_string(
        "/out/TB%s_W%d_ALT%dkm_S%03d/r.csv", F.col("l_tax").cast("string"), F.col("l_linenumber") * 10,
        F.col("l_suppkey") + 500, F.pmod("l_orderkey", F.lit(1000)),
    )
    return slots.scenario_metadata(li.select("l_orderkey", "l_linenumber", path.alias("path"))).drop("path")


@query("S11_parquet_scan", """SELECT l_orderkey, l_quantity FROM lineitem WHERE l_discount IS NOT NULL AND l_quantity IS NOT NULL""")
def parquet_scan(spark, sf_dir):
    df = slots.scan_features(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_discount"],
                             ["l_discount", "l_quantity"])
    return df.drop("l_discount")


@query("S12_split_parquet", f"WITH {TX} SELECT mcs, count(*) AS n, CAST(sum(tbs) AS BIGINT) AS tbs FROM tx GROUP BY mcs")
def split_parquet(spark, sf_dir):
    path = scratch_path(spark, "features")
    feature_flow.write_features(transmissions(spark, sf_dir), path, ROW_KEY)
    back = spark.read.parquet(path)
    return back.groupBy("mcs").agg(F.count(F.lit(1)).alias("n"), F.sum("tbs").alias("tbs"))


@query("S13_small_csv", f"WITH {TX} SELECT mcs, count(*) AS n, CAST(sum(tbs) AS BIGINT) AS tbs FROM tx GROUP BY mcs")
def small_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sums = transmissions(spark, sf_dir).groupBy("mcs").agg(F.count(F.lit(1)).alias("n"), F.sum("tbs").alias("tbs"))
    sinks.write_small_csv(sums, path, ["mcs"])
    return spark.read.schema("mcs int, n bigint, tbs bigint").option("header", "true").csv(path)


# --- row expressions -------------------------------------------------------------------------------

@query("P1_canonical_names", "SELECT l_orderkey AS slot, l_discount AS bler, l_tax AS target_bler, l_linenumber AS mcs FROM lineitem")
def canonical_names(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    messy = li.select(
        F.col("l_orderkey").alias(" Slot-Index "), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("BLER (percent)"),
        F.col("l_discount").alias("block error rate"), F.col("l_tax").alias("TargetBLER"), F.col("l_linenumber").alias("MCS.idx"),
    )
    return features.canonical_columns(messy)


@query("P2_sinr_promotion", """SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_tax END AS snr FROM lineitem""")
def sinr_promotion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return features.promote_sinr(li.select(
        "l_orderkey", F.col("l_tax").alias("ul_sinr"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("dl_sinr"),
    ))


@query("P3_clean_cast", """SELECT l_orderkey, l_quantity AS snr, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS mcs FROM lineitem""")
def clean_cast(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return features.clean_cast(li.select(
        "l_orderkey", F.concat(F.lit(" '"), F.col("l_quantity").cast("string"), F.lit("'")).alias("snr"),
        F.when(F.col("l_linenumber") == 1, "bad").otherwise(F.col("l_linenumber").cast("string")).alias("mcs"),
    ))


@query("P4_ack_to_blkerr", """SELECT l_orderkey, CAST(l_returnflag = 'A' AS TINYINT) AS from_text, CAST(l_linenumber = 1 AS TINYINT) AS from_status FROM lineitem""")
def ack_to_blkerr(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_returnflag") == "A", "Ack").when(F.col("l_returnflag") == "N", "NACK").otherwise("DTX")
    first = features.ack_to_blkerr(li.select("l_orderkey", "l_linenumber", text.alias("ack_result")))
    first = first.withColumnRenamed("blkerr", "from_text").drop("ack_result").withColumnRenamed("l_linenumber", "ack_status")
    return features.ack_to_blkerr(first).withColumnRenamed("blkerr", "from_status").drop("ack_status")


@query("P5_default_target", "SELECT l_orderkey, 10.0::DOUBLE AS target_bler FROM lineitem")
def default_target(spark, sf_dir):
    return features.default_target(table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("P6_derived_features", f"""WITH {TX}
SELECT l_orderkey, l_linenumber, snr, pathloss, cqi, round_even(snr, 0) AS snr_round, floor(snr * 2) / 2 AS snr_bin05,
  least(greatest(snr, -20), 50) AS snr_clip, round_even(pathloss, 0) AS pathloss_round, snr * cqi AS snr_cqi, snr * pathloss AS snr_pathloss
FROM (SELECT *, 150 + l_suppkey / 4.0::DOUBLE AS pathloss FROM tx)""", "snr_pathloss")
def derived_features(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "snr", (F.lit(150) + F.col("l_suppkey") / 4).alias("pathloss"), "cqi"
    )
    return features.derived_features(tx)


@query("P6_modulation_codes", """SELECT o_orderkey, o_orderpriority AS mod, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS mod_code FROM orders""")
def modulation_codes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("mod"))
    return features.modulation_codes(orders)


@query("P7_pass_label", f"""WITH {TX} SELECT {KEY_SQL}, CAST(bler <= target_bler AND blkerr = 1 AS TINYINT) AS pass_one,
  CAST(bler <= target_bler AND blkerr = 0 AS TINYINT) AS pass_zero FROM tx""")
def pass_label(spark, sf_dir):
    tx = transmissions(spark, sf_dir).drop("label_pass")
    one = features.pass_label(tx, 1).withColumnRenamed("label_pass", "pass_one")
    return features.pass_label(one, 0).select(*ROW_KEY, "pass_one", F.col("label_pass").alias("pass_zero"))


@query("P8_P9_feature_table", f"""WITH {TX} SELECT snr, CAST(NULL AS DOUBLE) AS pathloss, cqi, ele_angle, CAST(tbs AS DOUBLE) AS tbs, target_bler, mcs, bler,
  CAST(blkerr AS TINYINT) AS blkerr, CAST(label_pass AS TINYINT) AS label_pass FROM tx""")
def feature_table(spark, sf_dir):
    picked = features.feature_columns(transmissions(spark, sf_dir))
    aligned = features.align_schema(picked)
    return aligned.select("snr", "pathloss", "cqi", "ele_angle", "tbs", "target_bler", "mcs", "bler", "blkerr", "label_pass")


@query("P10_filters", f"WITH {TX} SELECT {KEY_SQL} FROM tx WHERE mcs BETWEEN 1 AND 15 AND bler < 0.05::DOUBLE AND blkerr = 1 AND snr IS NOT NULL")
def filters(spark, sf_dir):
    return features.numeric_filter(
        transmissions(spark, sf_dir), {"mcs": (1, 15)}, {"blkerr": 1}, {"bler": 0.05}, ["snr"]
    ).select(*ROW_KEY)


@query("P11_ack_text", """SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'ACK' WHEN 'N' THEN 'NACK' ELSE 'DTX' END AS ack_result,
  CASE WHEN l_linenumber % 2 > 0 THEN 'retransmission' ELSE 'new' END AS transmission_type, count(*) AS n FROM lineitem GROUP BY ALL""")
def ack_text(spark, sf_dir):
    tx = transmissions(spark, sf_dir)
    flag = F.when(F.col("ack_status") == 1, "A").when(F.col("ack_status") == 0, "N").otherwise("R").alias("l_returnflag")
    return tx.groupBy(
        flag, radio.ack_text("ack_status").alias("ack_result"), radio.transmission_type("nrtx").alias("transmission_type")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("P12_rrc_units", "SELECT l_orderkey, l_linenumber - 156.0::DOUBLE AS rsrp, l_linenumber / 2.0::DOUBLE - 43 AS rsrq, l_linenumber / 2.0::DOUBLE - 23 AS sinr FROM lineitem")
def rrc_units(spark, sf_dir):
    raw = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", radio.rsrp_dbm(raw).alias("rsrp"), radio.rsrq_db(raw).alias("rsrq"), radio.sinr_db(raw).alias("sinr")
    )


@query("P14_rate_columns", f"""WITH {TX} SELECT {KEY_SQL}, tbs * 8 / 1024 / 1000 AS throughput, CASE WHEN ack_status = 1 THEN tbs * 8 / 1024 / 1000 ELSE 0 END AS trueput,
  CASE WHEN blkerr = 1 THEN tbs ELSE 0 END / 1000 AS rate, tbs * 8 / 1000 AS legacy FROM tx""", "throughput trueput rate legacy", digits=10)
def rate_columns(spark, sf_dir):
    return transmissions(spark, sf_dir).select(
        *ROW_KEY, radio.throughput_mbps("tbs").alias("throughput"), radio.trueput_mbps("tbs", "ack_status").alias("trueput"),
        radio.slot_rate_kbps("tbs", "blkerr", 1).alias("rate"), radio.legacy_kbps("tbs", 1000).alias("legacy"),
    )


@query("P15_throughput_resolution", f"WITH {TX} SELECT {KEY_SQL}, tbs * 8 / 1000 AS throughput_mbps, tbs * 4 / 1000 AS trueput_mbps FROM tx", "throughput_mbps trueput_mbps")
def throughput_resolution(spark, sf_dir):
    legacy = transmissions(spark, sf_dir).select(
        *ROW_KEY, (F.col("tbs") * 8).alias("throughput_kbps_per_sec"), (F.col("tbs") * 4).alias("trueput_kbps_per_sec")
    )
    return metrics.resolve_throughput(legacy).select(*ROW_KEY, "throughput_mbps", "trueput_mbps")


@query("P16_relative_time", f"WITH {TX} SELECT {KEY_SQL}, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY ue_id)) / 1e6::DOUBLE AS rel FROM tx")
def relative_time(spark, sf_dir):
    return metrics.relative_time(transmissions(spark, sf_dir), ["ue_id"], out="rel").select(*ROW_KEY, "rel")


@query("P17_column_discovery", "SELECT l_quantity AS snr_db, l_discount AS eleange FROM lineitem")
def column_discovery(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("DL_SNR_dB"), F.col("l_discount").alias("eleAnge"))
    return df.select(F.col(features.find_column(df, "snr")).alias("snr_db"), F.col(features.find_column(df, "ele")).alias("eleange"))


@query("P19_J7_mcs_entry", f"""WITH {MCS} SELECT l_orderkey, l_linenumber, coalesce(m.qm, 0) AS qm, coalesce(m.rate, 0) AS rate, coalesce(m.eff, 0) AS eff
FROM (SELECT *, CAST(l_partkey % 35 AS INTEGER) AS mcs FROM lineitem) t LEFT JOIN mcs_table m ON m.mcs = t.mcs""")
def mcs_entry(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(35)).cast("int").alias("mcs"))
    return radio.with_mcs_entry(li).drop("mcs")


_CQI_ROWS = ", ".join(
    f"({cqi}, {qm}, {rate}, {eff}::DOUBLE, '{radio.MODULATION[qm]}')"
    for cqi, (qm, rate, eff) in enumerate(radio.CQI_TABLES["table2"], start=1)
)


@query("J8_cqi_entry", f"""WITH c(cqi, qm, rate_x1024, efficiency, modulation) AS (VALUES {_CQI_ROWS})
SELECT l_orderkey, l_linenumber, c.qm, c.rate_x1024, c.efficiency, c.modulation
FROM lineitem t LEFT JOIN c ON c.cqi = greatest(t.l_partkey % 16, 1)""")
def cqi_entry(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(16)).cast("int").alias("cqi"))
    return radio.with_cqi_entry(li, "cqi", "table2").drop("cqi")


@query("P20_link_geometry", f"""WITH g AS (
  SELECT l_orderkey, l_linenumber, l_orderkey * {radio.elevation_per_slot()!r}::DOUBLE AS elevation_deg,
    6371000.0::DOUBLE * sin(radians(l_orderkey * {radio.elevation_per_slot()!r}::DOUBLE)) AS v FROM lineitem),
s AS (SELECT *, sqrt(v * v + {600e3 ** 2 + 2 * 6371000.0 * 600e3!r}::DOUBLE) - v AS slant_m FROM g)
SELECT l_orderkey, l_linenumber, elevation_deg, slant_m,
  20 * log10({4 * 3.141592653589793 / (299792458.0 / 2e9)!r}::DOUBLE * slant_m) AS pathloss_db FROM s""", "elevation_deg slant_m pathloss_db", digits=4)
def link_geometry(spark, sf_dir):
    return radio.with_link_geometry(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query("P21_next_csi_slot", "SELECT l_orderkey, l_linenumber, CAST(5 * ceil((l_orderkey - 3) / 5.0::DOUBLE) + 3 AS BIGINT) AS csi_slot FROM lineitem")
def next_csi_slot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", radio.next_csi_slot("l_orderkey", 5, 3).alias("csi_slot"))


@query("P22_grid_label", "SELECT p_partkey, CAST(p_size AS INTEGER) AS grid_row, chr(CAST(65 + p_partkey % 5 AS INTEGER)) AS grid_col FROM part")
def grid_label(spark, sf_dir):
    letter = F.chr(F.lit(65) + F.pmod("p_partkey", F.lit(5)))
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), letter).alias("grid"))
    return features.split_grid_label(part, "grid").drop("grid")


# --- zips, grids, sets and samples -----------------------------------------------------------------

@query("J13_positional_zip", """WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS position, p_retailprice AS left_value FROM part),
b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS position, s_acctbal AS right_value FROM supplier)
SELECT position, left_value, right_value, left_value - right_value AS difference FROM a JOIN b USING (position)""")
def positional_zip(spark, sf_dir):
    zipped = correlate.zip_tables(
        table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), "p_partkey", "s_suppkey", "p_retailprice", "s_acctbal"
    )
    return zipped.withColumn("position", F.col("position").cast("bigint"))


@query("A26_distinct_modulations", """SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS "values", count(DISTINCT o_orderpriority) AS count FROM orders""")
def distinct_modulations(spark, sf_dir):
    return metrics.distinct_set(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("A26_difference_summary", """WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS position, p_retailprice AS x FROM part),
b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS position, s_acctbal AS y FROM supplier)
SELECT count(*) AS rows, min(x) AS left_min, max(x) AS left_max, min(y) AS right_min, max(y) AS right_max, avg(x - y) AS mean_difference,
  max(x - y) AS max_difference, min(x - y) AS min_difference FROM a JOIN b USING (position)""", "mean_difference")
def difference_summary(spark, sf_dir):
    return metrics.difference_summary(correlate.zip_tables(
        table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), "p_partkey", "s_suppkey", "p_retailprice", "s_acctbal"
    ))


@query("J14_scenario_grid", """SELECT t AS target_bler, w AS bler_window, a AS altitude_m, s AS seed, count(l_orderkey) AS rows
FROM unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS x1(t), unnest([1, 2, 3]) AS x2(w), unnest([600000.0::DOUBLE]) AS x3(a), unnest([1, 2]) AS x4(s)
LEFT JOIN lineitem ON l_tax = t AND l_linenumber = w GROUP BY ALL""")
def scenario_grid(spark, sf_dir):
    """Grid of scenarios with the rows that fall on each."""
    grid = correlate.scenario_grid(spark, [0.01, 0.05], [1, 2, 3], [600000.0], [1, 2])
    counts = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_tax").alias("target_bler"), F.col("l_linenumber").alias("bler_window")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return grid.join(counts, ["target_bler", "bler_window"], "left").na.fill(0, ["rows"])


@query("U1_union", "SELECT s_suppkey AS key, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    return slots.diagonal_union([s, c])


@query("U3_distinct", f"WITH {TX} SELECT DISTINCT snr, cqi FROM tx")
def distinct(spark, sf_dir):
    return sampling.distinct_values(transmissions(spark, sf_dir), "snr", "cqi")


@query("O1_sorted", f"WITH {TX} SELECT {KEY_SQL}, ts FROM tx ORDER BY ts")
def sorted_rows(spark, sf_dir):
    return transmissions(spark, sf_dir).select(*ROW_KEY, "ts").orderBy("ts", *ROW_KEY)


@query("O2_head_cap", "SELECT count(*) AS rows FROM (SELECT * FROM lineitem LIMIT 5000)")
def head_cap(spark, sf_dir):
    return sampling.head(table(spark, sf_dir, "lineitem"), 5000).agg(F.count(F.lit(1)).alias("rows"))


@query("O3_top_slices", "SELECT p_size AS slice, count(*) AS count FROM part GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10")
def top_slices(spark, sf_dir):
    return sampling.top_slices(table(spark, sf_dir, "part").withColumnRenamed("p_size", "slice"), "slice", 10, 2)


@query("O4_top_values_per_row", """WITH l AS (
  SELECT l_orderkey * 1000 + l_linenumber AS id, l_partkey, l_suppkey, l_extendedprice, unnest([struct_pack(f := 'l_discount', v := l_discount),
    struct_pack(f := 'l_quantity', v := l_quantity), struct_pack(f := 'l_tax', v := -l_tax)]) AS e FROM lineitem),
r AS (SELECT id, e.f AS feature, e.v AS value, row_number() OVER (PARTITION BY id, l_partkey, l_suppkey, l_extendedprice ORDER BY abs(e.v) DESC, e.f) AS rank FROM l)
SELECT id, feature, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def top_values_per_row(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), "l_discount", "l_quantity", (-F.col("l_tax")).alias("l_tax")
    )
    return sampling.top_values_per_row(li, "id", ["l_discount", "l_quantity", "l_tax"], 2)


@query("O5_random_sample", "SELECT least(1000, count(*)) AS rows, least(1000, count(*)) AS different, 0::BIGINT AS foreign_rows, true AS repeatable FROM lineitem")
def random_sample(spark, sf_dir):
    """Size and distinctness of a sample, rows of it that are not in the table, and whether drawing again gives it."""
    rows = transmissions(spark, sf_dir).select(*ROW_KEY, "snr")
    picked, again = (sampling.sample_rows(x, 1000, ROW_KEY) for x in (rows, rows.repartition(5)))
    foreign, same = picked.join(rows, ROW_KEY, "left_anti").count(), picked.exceptAll(again).isEmpty()
    return picked.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*ROW_KEY).alias("different")).select(
        "rows", "different", F.lit(foreign).cast("bigint").alias("foreign_rows"), F.lit(same).alias("repeatable")
    )


@query("O6_random_split", "SELECT count(*) AS rows, true AS near_share FROM lineitem")
def random_split(spark, sf_dir):
    """All rows have a side, and the test side is a fifth within five standard deviations."""
    split = sampling.random_split(transmissions(spark, sf_dir), 0.2, ROW_KEY)
    n, test = F.count("split"), F.sum((F.col("split") == "test").cast("long"))
    return split.agg(n.alias("rows"), (F.abs(test - 0.2 * n) <= 5 * F.sqrt(0.16 * n)).alias("near_share"))


_MD5_SHARE = "CAST('0x' || substr(md5(concat_ws('|', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("O6_portable_split", f"""SELECT CASE WHEN {_MD5_SHARE} < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split, count(*) AS rows,
  CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1""")
def portable_split(spark, sf_dir):
    """The rows of either side of a split that SQL draws by the same hash, by count and sums of keys."""
    split = sampling.random_split(table(spark, sf_dir, "lineitem"), 0.2, ROW_KEY[:4], portable=True)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("orders"), F.sum("l_partkey").alias("parts"))


@query("O7_exact_split", f"""WITH {TX}, n AS (SELECT mcs, count(*) AS n FROM tx GROUP BY mcs)
SELECT mcs, 'test' AS split, greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS rows FROM n
UNION ALL SELECT mcs, 'train', n - greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) FROM n""")
def exact_split(spark, sf_dir):
    split = sampling.exact_split(transmissions(spark, sf_dir).select(*ROW_KEY, "mcs"), 0.2, ROW_KEY, ["mcs"])
    return split.groupBy("mcs", "split").agg(F.count(F.lit(1)).alias("rows"))

