"""Driver tables projected onto the radio domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.radio import MCS_TABLE, efficiency
from ..operators.candidates import candidates, contexts
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Columns that identify a transmission row; together they are unique.
ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as transmissions with context, outcome and label."""
    c = F.col
    base = table(spark, sf_dir, "lineitem").select(
        *ROW_KEY,
        c("l_shipdate").cast("timestamp").alias("ts"),
        c("l_suppkey").cast("int").alias("ue_id"),
        F.pmod("l_partkey", F.lit(4)).cast("int").alias("harq_id"),
        F.pmod(c("l_orderkey") * 3 + c("l_linenumber"), F.lit(28)).cast("int").alias("mcs"),
        F.floor("l_extendedprice").cast("bigint").alias("tbs"),
        F.when(c("l_returnflag") == "A", 1.0).when(c("l_returnflag") == "N", 0.0).otherwise(2.0).alias("ack_status"),
        F.pmod(c("l_linenumber"), F.lit(2)).cast("int").alias("nrtx"),
        (c("l_quantity") / 2 - 10).alias("snr"),
        F.least(F.greatest(F.floor((c("l_quantity")) * 0.3) + F.pmod("l_partkey", F.lit(3)) - 1, F.lit(0)), F.lit(15)).cast("int").alias("cqi"),
        (F.pmod("l_orderkey", F.lit(9000)) / 100.0).alias("ele_angle"),
        c("l_discount").alias("bler"),
        c("l_tax").alias("target_bler"),
        (F.pmod(
            c("l_orderkey") * 7919 + c("l_partkey") * 104729 + c("l_suppkey") * 31 + c("l_linenumber") * 17,
            F.lit(10007),
        ) / 10007.0).alias("u"),
    )
    scored = base.withColumn("p", pass_probability(F.col("snr"), F.col("mcs")))
    label = (F.col("u") < F.col("p")).cast("int")
    return scored.withColumns({"label_pass": label, "blkerr": label})


def pass_probability(snr: Column, mcs: Column) -> Column:
    """Closed-form stand-in for a fitted model, cut to 9 digits."""
    return F.floor(1e9 / (1 + F.exp(-(0.6 * (snr - (mcs * 0.9 - 9.0))))) + 0.5) / 1e9


def scored(spark: SparkSession, sf_dir: str, unrolled: bool = False) -> DataFrame:
    """Transmissions with the candidate array."""
    return candidates(spread(transmissions(spark, sf_dir)), lambda m: pass_probability(F.col("snr"), m), unrolled=unrolled)


def scored_contexts(spark: SparkSession, sf_dir: str, *keys) -> DataFrame:
    """Distinct contexts of the transmissions with their number of rows ``n`` and the candidate array."""
    rows = contexts(transmissions(spark, sf_dir), keys)
    return candidates(rows, lambda m: pass_probability(F.col("snr"), m))


def p_sql(snr: str, mcs: str) -> str:
    return f"floor(1e9 / (1 + exp(-(0.6 * ({snr} - ({mcs} * 0.9::DOUBLE - 9.0::DOUBLE))))) + 0.5) / 1e9"


TX = f"""
base AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
    CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_suppkey AS INTEGER) AS ue_id,
    CAST(l_partkey % 4 AS INTEGER) AS harq_id,
    CAST((l_orderkey * 3 + l_linenumber) % 28 AS INTEGER) AS mcs,
    CAST(floor(l_extendedprice) AS BIGINT) AS tbs,
    CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS ack_status,
    CAST(l_linenumber % 2 AS INTEGER) AS nrtx,
    l_quantity / 2 - 10 AS snr,
    CAST(least(greatest(floor(l_quantity * 0.3::DOUBLE) + l_partkey % 3 - 1, 0), 15) AS INTEGER) AS cqi,
    (l_orderkey % 9000) / 100.0::DOUBLE AS ele_angle,
    l_discount AS bler, l_tax AS target_bler,
    ((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber * 17) % 10007) / 10007.0::DOUBLE AS u
  FROM lineitem),
tx0 AS (SELECT *, {p_sql('snr', 'mcs')} AS p FROM base),
tx AS (SELECT *, CAST(u < p AS INTEGER) AS label_pass, CAST(u < p AS INTEGER) AS blkerr FROM tx0)
"""

MCS_ROWS = ", ".join(
    f"({m}, {order}, {rate} / 1024.0::DOUBLE, {efficiency(m)!r}::DOUBLE)" for m, (order, rate) in enumerate(MCS_TABLE)
)
MCS = f"mcs_table(mcs, qm, rate, eff) AS (VALUES {MCS_ROWS})"

# Long candidates: one row per transmission and MCS.
CAND = f"""
{MCS},
cand AS (
  SELECT t.l_orderkey, t.l_partkey, t.l_suppkey, t.l_linenumber, t.l_extendedprice, t.snr, t.cqi, t.ele_angle,
    t.target_bler AS own_target, m.mcs AS m, {p_sql('t.snr', 'm.mcs')} AS cp, m.eff AS ceff
  FROM tx t CROSS JOIN mcs_table m)
"""

KEY_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the domain's log-order columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("event_id").alias("pos"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("int").alias("ue_id"),
        F.col("user_id").cast("int").alias("rnti"), F.lit(0).alias("harq_id"), "event_type", "value", k.alias("k"),
    )


def event_transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") == "click")
    return e.select(
        "file", "block", "pos", "ts", "ue_id", "rnti", "harq_id", F.pmod("k", F.lit(28)).cast("int").alias("mcs"),
        F.floor(F.col("value") * 10).cast("bigint").alias("tbs"), F.pmod("k", F.lit(2)).cast("int").alias("nrtx"),
    )


def event_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return e.select("file", "block", "pos", "ts", "ue_id", "rnti", "harq_id", F.pmod("k", F.lit(3)).cast("int").alias("ack"))


def event_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") == "view")
    return e.select(
        "file", "block", "pos", "ts", (F.col("k") - 156).cast("double").alias("dl_rsrp"),
        F.col("value").alias("dl_sinr"),
    )


EV = """
ev AS (
  SELECT event_id AS pos, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS INTEGER) AS ue_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
etx AS (
  SELECT pos, ts, ue_id, CAST(k % 28 AS INTEGER) AS mcs, CAST(floor(value * 10) AS BIGINT) AS tbs,
    CAST(k % 2 AS INTEGER) AS nrtx
  FROM ev WHERE event_type = 'click'),
efb AS (SELECT pos, ts, ue_id, CAST(k % 3 AS INTEGER) AS ack FROM ev WHERE event_type = 'purchase'),
em AS (SELECT pos, ts, CAST(k - 156 AS DOUBLE) AS dl_rsrp, value AS dl_sinr FROM ev WHERE event_type = 'view')
"""

# Half a day stands in for the feedback window of a radio log.
EVENT_WINDOW_MS = 12 * 3600 * 1000
