"""Aggregations, running and trailing windows, profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import metrics, ordered, profile
from .registry import query
from .tables import KEY_SQL, ROW_KEY, TX, table, transmissions

ORDER_SQL = f"ts, {KEY_SQL}"
ORDER = ["ts", *ROW_KEY]


def _radio(spark, sf_dir):
    return transmissions(spark, sf_dir).withColumns({"dl_sinr": F.col("snr"), "dl_rsrp": F.col("snr") * 2})


_BIN = "floor((SELECT min(snr) FROM tx)) + greatest(ceil(snr - floor((SELECT min(snr) FROM tx))) - 1, 0) + 0.5"


@query("A1_snr_error_curve", f"""WITH {TX}, b AS (SELECT *, {_BIN} AS snr_bin_center FROM tx),
g AS (SELECT snr_bin_center, count(ack_status) AS total_transmissions, count(*) FILTER (ack_status = 0) AS nack_count,
  round(avg(mcs), 4) AS avg_mcs, round(avg(tbs), 4) AS avg_tbs, round(avg(snr * 2), 4) AS avg_dl_rsrp FROM b GROUP BY 1)
SELECT *, nack_count / total_transmissions * 100 AS bler_percent FROM g""", "bler_percent")
def snr_error_curve(spark, sf_dir):
    return metrics.snr_error_curve(_radio(spark, sf_dir))


@query("A2_snr_throughput_curve", f"""WITH {TX}, b AS (SELECT *, {_BIN} AS snr_bin_center, tbs * 8 / 1024 / 1000 AS t,
  CASE WHEN ack_status = 1 THEN tbs * 8 / 1024 / 1000 ELSE 0 END AS tt FROM tx)
SELECT snr_bin_center, round(avg(t), 4) AS avg_throughput_mbps, round(stddev_samp(t), 4) AS std_throughput_mbps, count(t) AS sample_count,
  round(avg(mcs), 4) AS avg_mcs, round(avg(tbs), 4) AS avg_tbs, round(avg(tt), 4) AS avg_trueput_mbps, round(stddev_samp(tt), 4) AS std_trueput_mbps
FROM b GROUP BY 1""")
def snr_throughput_curve(spark, sf_dir):
    return metrics.snr_throughput_curve(metrics.throughput_columns(_radio(spark, sf_dir)))


@query("A3_error_by_mcs", f"""WITH {TX} SELECT mcs, count(*) AS count, round(avg(CAST(ack_status = 0 AS DOUBLE)) * 100, 2) AS bler_pct FROM tx
WHERE ack_status IS NOT NULL GROUP BY mcs HAVING count(*) >= 5""")
def error_by_mcs(spark, sf_dir):
    return metrics.error_by_mcs(transmissions(spark, sf_dir))


@query("A4_distribution", f"WITH {TX} SELECT mcs, count(*) AS count, count(*) / sum(count(*)) OVER () * 100 AS percent FROM tx GROUP BY mcs", "percent")
def distribution(spark, sf_dir):
    return metrics.distribution(transmissions(spark, sf_dir), "mcs")


@query("A5_harq_process_stats", f"""WITH {TX} SELECT ue_id || '_' || harq_id AS harq_process_key, count(*) AS attempts,
  count(*) FILTER (ack_status = 1) AS acks, count(*) FILTER (ack_status = 1) / count(*) AS efficiency FROM tx GROUP BY ue_id, harq_id""", "efficiency")
def harq_process_stats(spark, sf_dir):
    return metrics.harq_process_stats(transmissions(spark, sf_dir), ["ue_id", "harq_id"])


@query("A5_harq_totals", f"""WITH {TX} SELECT count(*) AS total_attempts, count(*) FILTER (ack_status = 1) AS successful_deliveries,
  sum(CASE WHEN ack_status = 1 THEN tbs ELSE 0 END) / sum(tbs) AS harq_efficiency FROM tx""", "harq_efficiency")
def harq_totals(spark, sf_dir):
    return metrics.harq_totals(transmissions(spark, sf_dir))


@query("A6_per_second", f"""WITH {TX}, r AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY ue_id)) / 1e6::DOUBLE AS rel FROM tx)
SELECT ue_id, CAST(floor(rel) AS BIGINT) AS window_start_time, sum(tbs * 8 / 1024 / 1000) AS throughput_mbps_per_sec,
  sum(CASE WHEN ack_status = 1 THEN tbs * 8 / 1024 / 1000 ELSE 0 END) AS trueput_mbps_per_sec FROM r GROUP BY ALL""", "throughput_mbps_per_sec trueput_mbps_per_sec", digits=10)
def per_second(spark, sf_dir):
    timed = metrics.relative_time(transmissions(spark, sf_dir), ["ue_id"])
    return metrics.per_second(metrics.throughput_columns(timed), ["ue_id"])


@query("A7_run_statistics", f"""WITH {TX} SELECT count(*) AS total_transmissions, min(mcs) AS mcs_min, max(mcs) AS mcs_max, min(tbs) AS tbs_min, max(tbs) AS tbs_max,
  count(ack_status) AS feedback_count, count(*) FILTER (ack_status = 0) * 100.0 / count(ack_status) AS bler_percent,
  count(*) FILTER (snr > 0) * 100.0 / count(*) AS dl_sinr_percent FROM tx""", "bler_percent dl_sinr_percent")
def run_statistics(spark, sf_dir):
    tx = transmissions(spark, sf_dir).withColumn("dl_sinr", F.when(F.col("snr") > 0, F.col("snr")))
    return metrics.run_statistics(tx)


# Every numeric column of the transmissions; bler has nulls here.
NUMERIC = ["snr", "cqi", "mcs", "tbs", "ele_angle", "bler", "target_bler", "ack_status", "nrtx", "harq_id", "ue_id", "blkerr", "label_pass", "p", "u"]
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({'CASE WHEN mcs = 3 THEN NULL ELSE bler END' if c == 'bler' else c} AS DOUBLE) AS v FROM tx" for c in NUMERIC
)
_RANKS = {"q1": 0.01, "q5": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}
_PICKED = ", ".join(f"max(v) FILTER (i = floor((n - 1) * {q}::DOUBLE + 0.5)) AS {name}" for name, q in _RANKS.items())


@query("A9_column_profile", f"""WITH {TX}, l AS ({_LONG}),
n AS (SELECT column_name, count(v) AS n FROM l GROUP BY 1),
o AS (SELECT l.column_name, v, n, row_number() OVER (PARTITION BY l.column_name ORDER BY v) - 1 AS i FROM l JOIN n USING (column_name) WHERE v IS NOT NULL)
SELECT column_name, count(*) AS rows, (count(*) - count(v)) / count(*) AS missing_fraction, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
  {', '.join(f'any_value(q.{name}) AS {name}' for name in _RANKS)}
FROM l JOIN (SELECT column_name, {_PICKED} FROM o GROUP BY 1) q USING (column_name) GROUP BY 1""", "missing_fraction mean std", digits=4)
def column_profile(spark, sf_dir):
    tx = transmissions(spark, sf_dir).withColumn("bler", F.when(F.col("mcs") != 3, F.col("bler")))
    return profile.column_profile(tx, NUMERIC)


@query("A10_rates", f"""WITH {TX} SELECT avg(label_pass) AS pass_rate, avg(CAST(blkerr = 1 AS DOUBLE)) AS ack_rate, avg(CAST(bler > target_bler AS DOUBLE)) AS violation_rate,
  avg(CASE WHEN blkerr = 1 THEN tbs ELSE 0 END) AS throughput_bytes_per_row_mean FROM tx""", "pass_rate ack_rate violation_rate throughput_bytes_per_row_mean")
def rates(spark, sf_dir):
    return profile.rates(transmissions(spark, sf_dir))


@query("A11_correlations", f"WITH {TX} " + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM tx" for a, b in combinations(NUMERIC, 2)
), "correlation")
def correlations(spark, sf_dir):
    return profile.correlations(transmissions(spark, sf_dir), NUMERIC)


@query("A12_histogram", f"""WITH {TX}, c AS (SELECT least(greatest(tbs, 20000), 60000) AS x FROM tx), s AS (SELECT min(x) AS lo, max(x) AS hi FROM c),
b AS (SELECT least(floor((x - lo) / ((hi - lo) / 30)), 29) AS bin, lo, hi FROM c, s)
SELECT CAST(bin AS BIGINT) AS bin, lo + bin * ((hi - lo) / 30) AS bin_lower, count(*) AS count FROM b GROUP BY bin, lo, hi""", "bin_lower")
def histogram(spark, sf_dir):
    return profile.histogram(transmissions(spark, sf_dir), "tbs", 30, (20000, 60000))


@query("A13_density", f"""WITH {TX}, d AS (SELECT snr AS x, least(greatest(bler * 12, 0), 1) AS y FROM tx),
s AS (SELECT min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM d)
SELECT CAST(least(floor((x - xlo) / ((xhi - xlo) / 60)), 59) AS BIGINT) AS x_bin, CAST(least(floor((y - ylo) / ((yhi - ylo) / 60)), 59) AS BIGINT) AS y_bin,
  count(*) AS count, log10(count(*)) AS log_count FROM d, s GROUP BY 1, 2""", "log_count")
def density(spark, sf_dir):
    return profile.density(transmissions(spark, sf_dir).withColumn("b", F.col("bler") * 12), "snr", "b")


@query("A14_pass_rate_by_mcs", f"WITH {TX} SELECT mcs, avg(label_pass) AS pass_rate FROM tx GROUP BY mcs", "pass_rate")
def pass_rate_by_mcs(spark, sf_dir):
    return profile.pass_rate_by(transmissions(spark, sf_dir), "mcs")


@query("A15_elevation_means", f"""WITH {TX} SELECT floor(ele_angle / 5) * 5 AS ele_bin, avg(1 - p) AS bler_avg, avg(mcs) AS mcs_avg, avg(bler) AS base FROM tx GROUP BY 1""", "bler_avg mcs_avg base")
def elevation_means(spark, sf_dir):
    return metrics.binned_means(
        transmissions(spark, sf_dir), "ele_angle", 5.0,
        {"bler_avg": 1 - F.col("p"), "mcs_avg": F.col("mcs"), "base": F.col("bler")}, "ele_bin",
    )


@query("A16_rounded_snr_means", f"WITH {TX} SELECT CAST(round_even(ele_angle * 10, 0) AS BIGINT) / 10.0::DOUBLE AS ele, avg(bler) AS bler, avg(tbs) AS rate FROM tx GROUP BY 1", "bler rate")
def rounded_snr_means(spark, sf_dir):
    return metrics.rounded_means(transmissions(spark, sf_dir), "ele_angle", {"bler": "bler", "rate": "tbs"}, out="ele")


@query("A17_best_mcs_per_snr", f"""WITH {TX} SELECT CAST(round_even(snr * 10, 0) AS BIGINT) / 10.0::DOUBLE AS snr_rounded, max(mcs) AS optimal_mcs, avg(cqi) AS cqi, avg(bler) AS bler,
  arg_min(target_bler, ({ORDER_SQL})) AS target_bler FROM tx WHERE blkerr = 1 GROUP BY 1""", "cqi bler")
def best_mcs_per_snr(spark, sf_dir):
    return metrics.best_mcs_per_snr(transmissions(spark, sf_dir), ["cqi", "bler"], ["target_bler"], ORDER)


# The types of the given tables, for the SQL twin; the query takes what the table has.
_PART_TYPES = ["SMALL", "ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"]


@query("A18_label_pivot", "SELECT p_size AS size, " + ", ".join(f"count(*) FILTER (p_type = '{t}') AS {t}" for t in _PART_TYPES) + " FROM part GROUP BY 1")
def label_pivot(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), "p_type")
    return metrics.label_pivot(part, "size", "p_type")


@query("A19_time_bin_pivot", """WITH t AS (SELECT epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 1e6::DOUBLE AS t, l_returnflag FROM lineitem), s AS (SELECT min(t) AS lo, max(t) AS hi FROM t)
SELECT CAST(least(greatest(ceil((t - lo) / ((hi - lo) / 50)) - 1, 0), 49) AS BIGINT) AS time_bin, count(*) FILTER (l_returnflag = 'A') AS A,
  count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM t, s GROUP BY 1""")
def time_bin_pivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("t"), "l_returnflag")
    return metrics.time_bin_pivot(li, "t", "l_returnflag", ["A", "N", "R"])


@query("A21_confusion", f"""WITH {TX}, c AS (SELECT ack_status AS a, CAST(label_pass AS DOUBLE) AS b, count(*) AS n FROM tx GROUP BY ALL)
SELECT x.v AS true_class, y.v AS pred_class, coalesce(n, 0) AS count FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) x(v)
CROSS JOIN (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) y(v) LEFT JOIN c ON c.a = x.v AND c.b = y.v""")
def confusion(spark, sf_dir):
    tx = transmissions(spark, sf_dir).withColumn("b", F.col("label_pass").cast("double"))
    return metrics.confusion(tx, "ack_status", "b", [0.0, 1.0, 2.0])


@query("A24_cqi_spread", f"""WITH {TX},
o AS (SELECT snr, CAST(cqi AS DOUBLE) AS cqi, row_number() OVER (PARTITION BY snr ORDER BY cqi) - 1 AS i, count(*) OVER (PARTITION BY snr) AS n FROM tx),
w AS (SELECT snr, n, q, least(greatest(n * q - 0.5, 0), n - 1) AS pos FROM (SELECT DISTINCT snr, n FROM o), (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) v(q)),
v AS (SELECT w.snr, q, a.cqi + (pos - floor(pos)) * (b.cqi - a.cqi) AS x FROM w JOIN o a ON a.snr = w.snr AND a.i = floor(pos) JOIN o b ON b.snr = w.snr AND b.i = ceil(pos)),
m AS (SELECT snr, max(x) FILTER (q = 0.5) AS cqi_median, max(x) FILTER (q = 0.05::DOUBLE) AS cqi_low, max(x) FILTER (q = 0.95::DOUBLE) AS cqi_high FROM v GROUP BY 1)
SELECT snr, cqi_median, cqi_low, cqi_high, avg(CAST(abs(cqi - cqi_median) > 1 AS DOUBLE)) AS far_share FROM o JOIN m USING (snr) GROUP BY ALL""", "cqi_median cqi_low cqi_high far_share")
def cqi_spread(spark, sf_dir):
    return profile.cqi_spread(transmissions(spark, sf_dir), "snr")


@query("A25_modal_value", f"WITH {TX} SELECT mcs FROM (SELECT mcs, count(*) AS n FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")
def modal_value(spark, sf_dir):
    return metrics.modal_value(transmissions(spark, sf_dir), "mcs")


# --- windows ---------------------------------------------------------------------------------------

@query("W1_running_error_rate", f"""WITH {TX} SELECT {KEY_SQL}, sum(CAST(ack_status = 0 AS INTEGER)) OVER w / row_number() OVER w * 100 AS running FROM tx
WINDOW w AS (ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "running")
def running_error_rate(spark, sf_dir):
    out = metrics.running_error_rate(
        transmissions(spark, sf_dir).select(*ROW_KEY, "ts", "ack_status"), [], ORDER, F.col("ack_status") == 0, "running"
    )
    return out.select(*ROW_KEY, "running")


@query("W2_cumulative", f"""WITH {TX} SELECT {KEY_SQL}, CAST(sum(tbs) OVER w AS BIGINT) AS cum_tbs, CAST(sum(CASE WHEN ack_status = 1 THEN tbs ELSE 0 END) OVER w AS BIGINT) AS cum_ok FROM tx
WINDOW w AS (PARTITION BY ue_id ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cumulative(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(
        *ROW_KEY, "ts", "ue_id", "tbs", F.when(F.col("ack_status") == 1, F.col("tbs")).otherwise(0).alias("ok")
    )
    return metrics.cumulative(tx, ["ue_id"], ORDER, {"cum_tbs": "tbs", "cum_ok": "ok"}).select(*ROW_KEY, "cum_tbs", "cum_ok")


_LAGS = {f"{c}_{lag}": (c, lag) for c in ("bler", "mcs", "tbs") for lag in (10, 1000, 1500, 2000, 5000)}


@query("W3_trailing_means", f"WITH {TX} SELECT {KEY_SQL}, " + ", ".join(
    f"avg({'CAST(round(bler * 100) AS INTEGER)' if c == 'bler' else c}) OVER (PARTITION BY ue_id ORDER BY {ORDER_SQL} ROWS {lag - 1} PRECEDING) AS {name}" for name, (c, lag) in _LAGS.items()
) + " FROM tx")
def trailing_means(spark, sf_dir):
    # Whole numbers, so that both engines divide the same exact sums.
    percent = F.round(F.col("bler") * 100).cast("int").alias("bler")
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, "ts", "ue_id", percent, "mcs", "tbs")
    return ordered.trailing(tx, ["ue_id"], ORDER, _LAGS).select(*ROW_KEY, *_LAGS)


_FRACTIONS = (10, 1000, 5000)


@query("W3_trailing_means_of_fractions", f"WITH {TX} SELECT {KEY_SQL}, " + ", ".join(
    f"CAST(sum(CAST(round(bler * 100) AS INTEGER)) OVER (PARTITION BY ue_id ORDER BY {ORDER_SQL} ROWS {lag - 1} PRECEDING) AS BIGINT) AS percents_{lag}" for lag in _FRACTIONS
) + " FROM tx")
def trailing_means_of_fractions(spark, sf_dir):
    """Means of a double column, times the rows of their frames: sums in whole percents, which have no rounding."""
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, "ts", "ue_id", "bler")
    numbered = ordered.running_sums(tx, ["ue_id"], ORDER, {"n": F.lit(1)})
    means = ordered.trailing(numbered, ["ue_id"], ORDER, {f"m_{lag}": ("bler", lag) for lag in _FRACTIONS})
    return means.select(*ROW_KEY, *[
        F.rint(F.col(f"m_{lag}") * F.least("n", F.lit(lag)) * 100).cast("long").alias(f"percents_{lag}") for lag in _FRACTIONS
    ])


@query("W4_padded_rolling", f"""WITH {TX}, g AS (SELECT floor(ele_angle) AS ele_bin, avg(mcs) AS m FROM tx GROUP BY 1),
r AS (SELECT ele_bin, row_number() OVER (ORDER BY ele_bin) AS rn, avg(m) OVER (ORDER BY ele_bin ROWS 4 PRECEDING) AS a FROM g)
SELECT ele_bin, CASE WHEN rn >= 5 THEN a ELSE (SELECT a FROM r WHERE rn = 5) END AS m FROM r""", "m")
def padded_rolling(spark, sf_dir):
    bins = metrics.binned_means(transmissions(spark, sf_dir), "ele_angle", 1.0, {"m": F.col("mcs")}, "ele_bin")
    return ordered.padded_rolling(bins, "ele_bin", ["m"], 5)


@query("W5_windowed_error_rate", f"""WITH {TX} SELECT {KEY_SQL}, avg(1 - blkerr) OVER (PARTITION BY ue_id ORDER BY {ORDER_SQL} ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS bler_window FROM tx""")
def windowed_error_rate(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, "ts", "ue_id", "blkerr")
    return ordered.windowed_error_rate(tx, ["ue_id"], ORDER, 1000, F.col("blkerr") == 0).select(*ROW_KEY, "bler_window")


@query("W5_windowed_error_rate_compat", f"""WITH {TX}, s AS (
  SELECT {KEY_SQL}, row_number() OVER w - 1 AS n, sum(1 - blkerr) OVER (PARTITION BY ue_id ORDER BY {ORDER_SQL} ROWS BETWEEN 1001 PRECEDING AND 1 PRECEDING) AS wide FROM tx
  WINDOW w AS (PARTITION BY ue_id ORDER BY {ORDER_SQL}))
SELECT {KEY_SQL}, CASE WHEN n > 1000 THEN wide / 1000 WHEN n > 0 THEN wide / n END AS bler_window FROM s""")
def windowed_error_rate_compat(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select(*ROW_KEY, "ts", "ue_id", "blkerr")
    return ordered.windowed_error_rate(tx, ["ue_id"], ORDER, 1000, F.col("blkerr") == 0, compat=True).select(*ROW_KEY, "bler_window")


@query("W7_systematic_sample", f"""WITH {TX}, r AS (SELECT {KEY_SQL}, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS i, count(*) OVER () AS n FROM tx)
SELECT {KEY_SQL} FROM r WHERE i % greatest(1, n // least(1000, n)) = 0""")
def systematic_sample(spark, sf_dir):
    return ordered.systematic_sample(transmissions(spark, sf_dir).select(*ROW_KEY, "ts"), ORDER, 1000).select(*ROW_KEY)


@query("W8_first_per_group", f"WITH {TX} SELECT ue_id, arg_min(mcs, ({ORDER_SQL})) AS mcs, arg_min(snr, ({ORDER_SQL})) AS snr FROM tx GROUP BY 1")
def first_per_group(spark, sf_dir):
    return ordered.first_per_group(transmissions(spark, sf_dir), ["ue_id"], ORDER, ["mcs", "snr"])

