"""Log sources, event extraction and correlation over text rendered from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, metrics
from ..plans import log_flow
from ..session import scratch_path
from ..sources import logs, sinks
from .registry import query
from .tables import (
    EV,
    EVENT_WINDOW_MS,
    event_feedback,
    event_measurements,
    event_transmissions,
    events,
)

LINES_PER_EVENT = 6
SOURCE_EVENTS = 2000


def rendered(spark, sf_dir):
    """Six log lines per event (blank where unused); only some events carry a timestamp line."""
    e = events(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rnti = F.format_string("%04x", F.col("ue_id") + 17921)
    link = [F.col("ue_id"), rnti]
    kind = F.col("event_type")
    body = (
        F.when(kind == "click", F.format_string(
            "- UE PDSCH: ue=%d c-rnti=0x%s h_id=%d ss_id=2 rb=[%d..%d) symb=[2..14) tbs=%d mcs=%d rv=0 nrtx=%d k1=4",
            *link, F.pmod("pos", F.lit(4)), F.col("k"), F.col("k") + 24, F.floor(F.col("value") * 10),
            F.pmod("k", F.lit(28)), F.pmod("k", F.lit(2))))
        .when(kind == "purchase", F.format_string(
            "- HARQ-ACK: ue=%d rnti=0x%s slot_rx=100.5 h_id=%d ack=%d tbs=%d",
            *link, F.pmod("pos", F.lit(4)), F.pmod("k", F.lit(3)), F.floor(F.col("value") * 10)))
        .when(kind == "view", F.format_string(
            "[METRICS] Scheduler UE pci=1 rnti=0x%s pusch_snr_db=%d.5 pusch_mcs=20", rnti, F.col("k")))
        .when(kind == "signup", F.format_string("[RRC] ue=%d c-rnti=0x%s: Containerized measurementReport", *link))
        .otherwise(F.format_string("- CRC: ue=%d rnti=0x%s crc=OK sinr=%d.25dB", *link, F.col("k") - 20))
    )
    report = kind == "signup"
    blank = F.lit("")
    lines = F.array(
        F.when(F.pmod("pos", F.lit(3)) != 1, F.concat(stamp, F.lit(" [SCHED] [I] slot"))).otherwise(blank),
        body,
        F.when(report, F.format_string('"rsrp": %d,', F.col("k")))
        .when(kind == "error", F.format_string("olla_target_bler: 0.%d", F.col("k"))).otherwise(blank),
        F.when(report, F.format_string('"rsrq": %d,', F.col("k") + 1)).otherwise(blank),
        F.when(report, F.format_string('"sinr": %d', F.col("k") + 2)).otherwise(blank),
        F.when(report, "}").otherwise(blank),
    )
    source = F.floor(F.col("pos") / SOURCE_EVENTS)
    return e.select(source.alias("source"), F.col("pos").alias("event"), F.posexplode(lines).alias("i", "value")).select(
        "source", F.lit("events").alias("file"), F.col("source").alias("block"),
        (F.col("event") * LINES_PER_EVENT + F.col("i")).alias("pos"),
        (F.col("event") * LINES_PER_EVENT + F.col("i")).alias("line_no"), "value",
    )


def lines_of(spark, sf_dir):
    return rendered(spark, sf_dir).where(F.col("value") != "").drop("source")


def written_log(spark, sf_dir):
    """Folder of log files, one per source; each file holds its lines in order."""
    path = scratch_path(spark, "log")
    rows = rendered(spark, sf_dir).repartition("source").sortWithinPartitions("source", "pos")
    rows.select("source", "value").write.partitionBy("source").text(path)
    return path


STAMPED = f"""
{EV},
st AS (
  SELECT *, last_value(CASE WHEN pos % 3 <> 1 THEN ts END IGNORE NULLS)
    OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cts
  FROM ev)
"""

_BODY_SQL = """
CASE event_type
  WHEN 'click' THEN format('- UE PDSCH: ue={} c-rnti=0x{:04x} h_id={} ss_id=2 rb=[{}..{}) symb=[2..14) tbs={} mcs={} rv=0 nrtx={} k1=4',
    ue_id, ue_id + 17921, pos % 4, k, k + 24, CAST(floor(value * 10) AS BIGINT), k % 28, k % 2)
  WHEN 'purchase' THEN format('- HARQ-ACK: ue={} rnti=0x{:04x} slot_rx=100.5 h_id={} ack={} tbs={}',
    ue_id, ue_id + 17921, pos % 4, k % 3, CAST(floor(value * 10) AS BIGINT))
  WHEN 'view' THEN format('[METRICS] Scheduler UE pci=1 rnti=0x{:04x} pusch_snr_db={}.5 pusch_mcs=20', ue_id + 17921, k)
  WHEN 'signup' THEN format('[RRC] ue={} c-rnti=0x{:04x}: Containerized measurementReport', ue_id, ue_id + 17921)
  ELSE format('- CRC: ue={} rnti=0x{:04x} crc=OK sinr={}.25dB', ue_id, ue_id + 17921, k - 20) END
"""

RENDERED = f"""
{EV},
parts AS (
  SELECT pos, 0 AS i, CASE WHEN pos % 3 <> 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ' [SCHED] [I] slot' ELSE '' END AS value FROM ev
  UNION ALL SELECT pos, 1, {_BODY_SQL} FROM ev
  UNION ALL SELECT pos, 2, CASE event_type WHEN 'signup' THEN format('"rsrp": {{}},', k)
    WHEN 'error' THEN format('olla_target_bler: 0.{{}}', k) ELSE '' END FROM ev
  UNION ALL SELECT pos, 3, CASE WHEN event_type = 'signup' THEN format('"rsrq": {{}},', k + 1) ELSE '' END FROM ev
  UNION ALL SELECT pos, 4, CASE WHEN event_type = 'signup' THEN format('"sinr": {{}}', k + 2) ELSE '' END FROM ev
  UNION ALL SELECT pos, 5, CASE WHEN event_type = 'signup' THEN '}}' ELSE '' END FROM ev),
numbered AS (
  SELECT pos // 2000 AS source, row_number() OVER (PARTITION BY pos // 2000 ORDER BY pos, i) - 1 AS line_no, value FROM parts)
"""


@query("S1_log_scan", f"WITH {RENDERED} SELECT source, line_no, value FROM numbered WHERE value <> ''")
def log_scan(spark, sf_dir):
    lines = logs.number_lines(spark, written_log(spark, sf_dir)).where(F.col("value") != "")
    source = F.regexp_extract("file", r"source=(\d+)", 1).cast("bigint")
    return lines.select(source.alias("source"), "line_no", "value")


@query("A28_file_line_count", f"WITH {RENDERED} SELECT source, count(*) AS lines FROM numbered WHERE value <> '' GROUP BY 1")
def file_line_count(spark, sf_dir):
    counts = logs.line_count(logs.scan_log(spark, written_log(spark, sf_dir)))
    return counts.select(F.regexp_extract("file", r"source=(\d+)", 1).cast("bigint").alias("source"), "lines")


@query("S2_pdsch_events", f"""WITH {STAMPED}
SELECT cts AS ts, ue_id, ue_id + 17921 AS rnti, CAST(pos % 4 AS INTEGER) AS harq_id, CAST(k % 28 AS INTEGER) AS mcs,
  CAST(floor(value * 10) AS BIGINT) AS tbs, CAST(k % 2 AS INTEGER) AS nrtx, pos * 6 + 1 AS pos
FROM st WHERE event_type = 'click' AND cts IS NOT NULL""")
def pdsch_events(spark, sf_dir):
    return logs.pdsch_events(logs.classified(lines_of(spark, sf_dir))).drop("file", "block")


@query("S2_harq_events", f"""WITH {STAMPED}
SELECT cts AS ts, ue_id, ue_id + 17921 AS rnti, CAST(pos % 4 AS INTEGER) AS harq_id, CAST(k % 3 AS INTEGER) AS ack,
  CAST(floor(value * 10) AS BIGINT) AS tbs, pos * 6 + 1 AS pos
FROM st WHERE event_type = 'purchase' AND cts IS NOT NULL""")
def harq_events(spark, sf_dir):
    return logs.harq_events(logs.classified(lines_of(spark, sf_dir))).drop("file", "block")


@query("S2_ul_measurements", f"""WITH {STAMPED}
SELECT cts AS ts, 0 AS ue_id, ue_id + 17921 AS rnti, CAST(NULL AS INTEGER) AS harq_id, k + 0.5::DOUBLE AS ul_sinr, pos * 6 + 1 AS pos
FROM st WHERE event_type = 'view' AND cts IS NOT NULL""")
def ul_measurements(spark, sf_dir):
    return logs.ul_measurements(logs.classified(lines_of(spark, sf_dir))).drop("file", "block")


@query("S3_wide_pdsch", f"""WITH {STAMPED}
SELECT cts AS ts, ue_id, format('0x{{:04x}}', ue_id + 17921) AS c_rnti, CAST(pos % 4 AS INTEGER) AS harq_id, k AS rb_start, k + 24 AS rb_end,
  2 AS symb_start, 14 AS symb_end, CAST(floor(value * 10) AS BIGINT) AS tbs, CAST(k % 28 AS INTEGER) AS mcs, 0 AS rv,
  CAST(k % 2 AS INTEGER) AS nrtx, 4 AS k1, pos * 6 + 1 AS pos
FROM st WHERE event_type = 'click'""")
def wide_pdsch(spark, sf_dir):
    return logs.wide_pdsch_events(lines_of(spark, sf_dir)).drop("file", "block")


@query("S3_crc_sinr", f"""WITH {STAMPED}
SELECT cts AS ts, CASE WHEN k >= 20 THEN (k - 20) + 0.25::DOUBLE ELSE (k - 20) - 0.25::DOUBLE END AS actual_sinr, pos * 6 + 1 AS pos
FROM st WHERE event_type = 'error' AND k <> 20
UNION ALL SELECT cts, 0.25::DOUBLE, pos * 6 + 1 FROM st WHERE event_type = 'error' AND k = 20""")
def crc_sinr(spark, sf_dir):
    return logs.crc_sinr(lines_of(spark, sf_dir)).drop("file", "block")


@query("S4_measurement_reports", f"""WITH {STAMPED}
SELECT cts AS ts, ue_id, ue_id + 17921 AS rnti, k - 156.0::DOUBLE AS dl_rsrp, (k + 1) / 2.0::DOUBLE - 43 AS dl_rsrq,
  (k + 2) / 2.0::DOUBLE - 23 AS dl_sinr, pos * 6 + 1 AS pos
FROM st WHERE event_type = 'signup' AND cts IS NOT NULL""")
def measurement_reports(spark, sf_dir):
    return logs.dl_measurements(lines_of(spark, sf_dir)).drop("file", "block")


@query("S5_config_values", f"""WITH {EV}
SELECT 'olla_target_bler' AS param, '0.' || arg_max(k, pos) AS value, 'float' AS value_type FROM ev WHERE event_type = 'error'""")
def config_values(spark, sf_dir):
    return logs.config_values(lines_of(spark, sf_dir)).drop("file")


@query("P13_timestamp_parsing", f"""WITH {EV}
SELECT pos, ts AS seven_digits, date_trunc('millisecond', ts) AS three_digits, CAST(NULL AS TIMESTAMP) AS broken FROM ev""")
def timestamp_parsing(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events(spark, sf_dir).select(
        "pos", logs.parse_timestamp(F.concat(text, F.lit("7"))).alias("seven_digits"),
        logs.parse_timestamp(F.substring(text, 1, 23)).alias("three_digits"),
        logs.parse_timestamp(F.concat(F.lit("x"), text)).alias("broken"),
    )


@query("W6_timestamp_carry_forward", f"WITH {STAMPED} SELECT pos, cts AS ts FROM st")
def timestamp_carry_forward(spark, sf_dir):
    e = events(spark, sf_dir).select(
        "file", F.floor(F.col("pos") / 500).alias("block"), "pos",
        F.when(F.pmod("pos", F.lit(3)) != 1, F.col("ts")).alias("line_ts"),
    )
    return logs.carry_forward(e).select("pos", "ts")


# --- correlation -----------------------------------------------------------------------------------

_MATCH = f"""{EV},
pairs AS (
  SELECT t.pos, f.pos AS fpos, f.ts AS fts, f.ack, row_number() OVER (PARTITION BY t.pos ORDER BY f.pos) AS rn
  FROM etx t JOIN efb f ON t.ue_id = f.ue_id AND f.ts >= t.ts AND f.ts <= t.ts + INTERVAL 12 HOUR),
m AS (
  SELECT t.*, p.fts AS harq_timestamp, p.ack,
    (epoch_us(p.fts) - epoch_us(t.ts)) / 1000.0::DOUBLE AS time_diff_ms
  FROM etx t LEFT JOIN pairs p ON t.pos = p.pos AND p.rn = 1)
"""


def _tx_fb(spark, sf_dir):
    return event_transmissions(spark, sf_dir), event_feedback(spark, sf_dir)


@query("J1_first_feedback", f"WITH {_MATCH} SELECT pos, ts, ue_id, mcs, tbs, nrtx, harq_timestamp, ack, time_diff_ms FROM m", "time_diff_ms")
def first_feedback(spark, sf_dir):
    tx, fb = _tx_fb(spark, sf_dir)
    return correlate.first_feedback(tx, fb, EVENT_WINDOW_MS).drop("file", "block", "rnti", "harq_id")


# One step for each event of a link, all links at once: what waits for feedback, the first feedback of this instant, and
# what the event settles.
CONSUMED = f"""{EV},
a AS (SELECT ue_id, pos, epoch_us(ts) AS us, true AS is_tx FROM etx UNION ALL SELECT ue_id, pos, epoch_us(ts), false FROM efb),
e AS (SELECT *, row_number() OVER (PARTITION BY ue_id ORDER BY us, pos) AS n FROM a),
s(ue_id, n, waiting, answer, tx_pos, fb_pos, retired) AS (
  SELECT DISTINCT ue_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(us BIGINT, pos BIGINT)[]), CAST(NULL AS STRUCT(us BIGINT, pos BIGINT)),
    CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM e
  UNION ALL
  SELECT ue_id, n,
    CASE WHEN is_tx THEN list_append(live, struct_pack(us := us, pos := pos)) WHEN taken IS NULL THEN live ELSE list_filter(live, lambda r: r.pos <> taken) END,
    CASE WHEN is_tx OR answer.us = us THEN answer ELSE struct_pack(us := us, pos := pos) END,
    CASE WHEN NOT is_tx THEN taken WHEN answer.us = us THEN pos END,
    CASE WHEN NOT is_tx AND taken IS NOT NULL THEN pos WHEN is_tx AND answer.us = us THEN answer.pos END,
    NOT is_tx AND taken IS NOT NULL
  FROM (SELECT *, list_filter(live, lambda r: r.us // 10000 = live[len(live)].us // 10000)[1].pos AS taken FROM (
    SELECT s.ue_id, e.n, e.us, e.pos, e.is_tx, s.answer, list_filter(s.waiting, lambda r: e.us - r.us <= {EVENT_WINDOW_MS * 1000}) AS live
    FROM s JOIN e ON e.ue_id = s.ue_id AND e.n = s.n + 1))),
matched AS (SELECT tx_pos, fb_pos, retired FROM s WHERE fb_pos IS NOT NULL)"""
_SENT = "t.pos, t.ts, t.ue_id, t.ue_id AS rnti, 0 AS harq_id, t.mcs, t.tbs, t.nrtx"


@query("J2_consuming_feedback", f"""WITH RECURSIVE {CONSUMED}
SELECT {_SENT}, f.ts AS harq_timestamp, f.ack, (epoch_us(f.ts) - epoch_us(t.ts)) / 1000.0::DOUBLE AS time_diff_ms
FROM etx t JOIN matched m ON m.tx_pos = t.pos JOIN efb f ON f.pos = m.fb_pos
UNION ALL SELECT {_SENT}, NULL, NULL, NULL FROM etx t WHERE t.pos NOT IN (SELECT tx_pos FROM matched WHERE retired)""", "time_diff_ms")
def consuming_feedback(spark, sf_dir):
    tx, fb = _tx_fb(spark, sf_dir)
    return correlate.consuming_feedback(tx, fb, EVENT_WINDOW_MS).drop("file", "block")


@query("J3_unmatched_transmissions", f"WITH {_MATCH} SELECT pos, ts, ue_id, mcs, tbs, nrtx FROM m WHERE harq_timestamp IS NULL")
def unmatched(spark, sf_dir):
    tx, fb = _tx_fb(spark, sf_dir)
    return correlate.unmatched_transmissions(tx, fb, EVENT_WINDOW_MS).drop("file", "block", "rnti", "harq_id")


@query("J3_unmatched_labels", f"""WITH {_MATCH} SELECT coalesce(CAST(ack AS DOUBLE), 2.0) AS ack_status,
  CASE ack WHEN 1 THEN 'ACK' WHEN 0 THEN 'NACK' ELSE 'DTX' END AS ack_result,
  CASE WHEN nrtx > 0 THEN 'retransmission' ELSE 'new' END AS transmission_type, count(*) AS n FROM m GROUP BY ALL""")
def unmatched_labels(spark, sf_dir):
    tx, fb = _tx_fb(spark, sf_dir)
    labelled = correlate.label_feedback(correlate.first_feedback(tx, fb, EVENT_WINDOW_MS))
    return labelled.groupBy("ack_status", "ack_result", "transmission_type").agg(F.count(F.lit(1)).alias("n"))


@query("J4_nearest_measurement", f"""WITH {EV},
gaps AS (
  SELECT t.pos, t.ts, t.mcs, m.dl_sinr, abs(epoch_us(m.ts) - epoch_us(t.ts)) AS gap,
    row_number() OVER (PARTITION BY t.pos ORDER BY abs(epoch_us(m.ts) - epoch_us(t.ts)), m.pos) AS rn
  FROM etx t JOIN em m ON m.ts BETWEEN t.ts - INTERVAL 600 SECOND AND t.ts + INTERVAL 600 SECOND)
SELECT pos, ts, mcs, dl_sinr, gap / 1e6::DOUBLE AS time_diff FROM gaps WHERE rn = 1""", "time_diff")
def nearest_measurement(spark, sf_dir):
    out = correlate.nearest_measurement(
        event_transmissions(spark, sf_dir), event_measurements(spark, sf_dir), "dl_sinr", 600.0
    )
    return out.select("pos", "ts", "mcs", "dl_sinr", "time_diff")


@query("J5_bucket_measurement", f"""WITH {EV},
firsts AS (
  SELECT epoch_us(ts) // 1800000000 AS b, arg_min(dl_rsrp, pos) AS dl_rsrp, arg_min(dl_sinr, pos) AS dl_sinr FROM em GROUP BY 1),
t AS (SELECT *, epoch_us(ts) // 1800000000 AS b FROM etx)
SELECT t.pos, t.mcs,
  CASE WHEN a.b IS NOT NULL THEN a.dl_rsrp WHEN p.b IS NOT NULL THEN p.dl_rsrp ELSE n.dl_rsrp END AS dl_rsrp,
  CASE WHEN a.b IS NOT NULL THEN a.dl_sinr WHEN p.b IS NOT NULL THEN p.dl_sinr ELSE n.dl_sinr END AS dl_sinr
FROM t LEFT JOIN firsts a ON a.b = t.b LEFT JOIN firsts p ON p.b = t.b - 1 LEFT JOIN firsts n ON n.b = t.b + 1""")
def bucket_measurement(spark, sf_dir):
    out = correlate.bucket_measurement(
        event_transmissions(spark, sf_dir), event_measurements(spark, sf_dir), ["dl_rsrp", "dl_sinr"], 1800
    )
    return out.select("pos", "mcs", "dl_rsrp", "dl_sinr")


@query("J6_per_second_back_join", f"""WITH {EV},
r AS (SELECT pos, tbs, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) // 3600000000 AS bucket FROM etx)
SELECT pos, CAST(bucket AS BIGINT) AS bucket, CAST(sum(tbs) OVER (PARTITION BY bucket) AS BIGINT) AS tbs_in_bucket FROM r""")
def per_second_back_join(spark, sf_dir):
    rel = metrics.relative_time(event_transmissions(spark, sf_dir))
    rel = rel.withColumn("bucket", F.floor(F.col("pdsch_time_relative_s") / 3600).cast("bigint"))
    joined = correlate.back_join_totals(rel, ["file", "bucket"], {"tbs_in_bucket": F.sum("tbs")})
    return joined.select("pos", "bucket", "tbs_in_bucket")


@query("A8_mcs_sinr_summary", f"""WITH {EV},
gaps AS (
  SELECT t.pos, t.mcs, m.dl_sinr AS sinr_db,
    row_number() OVER (PARTITION BY t.pos ORDER BY abs(epoch_us(m.ts) - epoch_us(t.ts)), m.pos) AS rn
  FROM etx t JOIN em m ON m.ts BETWEEN t.ts - INTERVAL 600 SECOND AND t.ts + INTERVAL 600 SECOND),
g AS (SELECT * FROM gaps WHERE rn = 1),
c AS (SELECT mcs FROM g GROUP BY mcs ORDER BY count(*) DESC, mcs LIMIT 1)
SELECT count(*) AS pairs, min(mcs) AS mcs_min, max(mcs) AS mcs_max, min(sinr_db) AS sinr_min, max(sinr_db) AS sinr_max,
  avg(sinr_db) AS sinr_mean, stddev_pop(sinr_db) AS sinr_std, (SELECT mcs FROM c) AS most_common_mcs FROM g""", "sinr_mean sinr_std")
def mcs_sinr_summary(spark, sf_dir):
    near = correlate.nearest_measurement(
        event_transmissions(spark, sf_dir), event_measurements(spark, sf_dir), "dl_sinr", 600.0
    )
    return metrics.mcs_sinr_summary(near.withColumnRenamed("dl_sinr", "sinr_db"))


@query("A27_linear_trend", f"""WITH {EV},
gaps AS (
  SELECT t.pos, t.mcs, m.dl_sinr AS sinr_db,
    row_number() OVER (PARTITION BY t.pos ORDER BY abs(epoch_us(m.ts) - epoch_us(t.ts)), m.pos) AS rn
  FROM etx t JOIN em m ON m.ts BETWEEN t.ts - INTERVAL 600 SECOND AND t.ts + INTERVAL 600 SECOND)
SELECT regr_slope(mcs, sinr_db) AS slope, regr_intercept(mcs, sinr_db) AS intercept FROM gaps WHERE rn = 1""", "slope intercept")
def linear_trend(spark, sf_dir):
    near = correlate.nearest_measurement(
        event_transmissions(spark, sf_dir), event_measurements(spark, sf_dir), "dl_sinr", 600.0
    )
    return metrics.linear_trend(near, "mcs", "dl_sinr")


@query("plan_log_to_snr_curve")
def log_to_snr_curve(spark, sf_dir):
    """Log text to the SNR curve: events, correlation, measurements, rates, bins."""
    flow = log_flow.transmissions_from_lines(lines_of(spark, sf_dir))
    return metrics.snr_error_curve(flow, "dl_sinr")


@query("S15_saved_transmissions", f"""WITH {_MATCH} SELECT count(*) AS rows, CAST(sum(tbs) AS BIGINT) AS tbs,
  count(harq_timestamp) AS matched FROM m""")
def saved_transmissions(spark, sf_dir):
    tx, fb = _tx_fb(spark, sf_dir)
    flow = log_flow.finish(
        correlate.bucket_measurement(
            correlate.first_feedback(tx, fb, EVENT_WINDOW_MS), event_measurements(spark, sf_dir), ["dl_rsrp", "dl_sinr"]
        ).withColumns({"dl_rsrq": F.lit(None).cast("double"), "ul_sinr": F.lit(None).cast("double")})
    )
    path = scratch_path(spark, "transmissions")
    sinks.write_transmissions(flow, path)
    back = sinks.read_transmissions(spark, path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("tbs").alias("tbs"), F.count("harq_timestamp").alias("matched"))
