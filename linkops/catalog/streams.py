"""Streaming operators run to the end of the driver tables, beside their batch results."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import replay
from ..session import materialize, scratch_path
from ..streaming import feedback, metrics, sinks, state
from .logs import CONSUMED, written_log
from .registry import query
from .tables import (
    EV,
    EVENT_WINDOW_MS,
    ROW_KEY,
    TX,
    event_feedback,
    event_transmissions,
    events,
    scored,
    transmissions,
)

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _table_stream(df, label, order=None, last=None, files=8):
    """Write ``df`` in the order of ``order`` and open it as a stream of ``files`` triggers.

    A trigger takes a file a core, as one file would be read by one task however large it is. ``last`` (a frame of one
    row) comes after all of them, to carry the watermark past the end of the input.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    each = spark.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(files * each, order) if order else df.repartition(files * each)
    ranged.write.parquet(path)
    # A file stream goes by modification time; the parts of one write differ by chance only.
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    first = {f.getPath().getName() for f in fs.listStatus(where)}
    if last is not None:
        last.select(df.columns).coalesce(1).write.mode("append").parquet(path)
    parts = [f for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")]
    start = min(f.getModificationTime() for f in parts)
    written = sorted(parts, key=lambda f: (f.getPath().getName() not in first, f.getPath().getName()))
    for i, f in enumerate(written):
        fs.setTimes(f.getPath(), start + 1000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def _after(df, gap, ts="ts", **values):
    """One row of ``df`` moved ``gap`` behind its last time."""
    end = df.agg((F.max(ts) + F.expr(f"interval {gap}")).alias("_end"))
    row = df.limit(1).join(F.broadcast(end)).withColumn(ts, F.col("_end")).drop("_end")
    return row.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


@contextmanager
def _settings(spark, values):
    """Session settings inside the block; the former ones come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _drain(stream, label, mode="append"):
    """Run a stream to the end of its input into a Parquet table and read that."""
    spark = stream.sparkSession
    path, check = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    # Each trigger opens and commits the stores of all partitions, rows or none, so these go by the cores.
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    with _settings(spark, {
        "spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(partitions),
    }):
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", check)
        if mode == "append":
            run = writer.format("parquet").option("path", path).start()
        else:
            # Complete output replaces the small result table on every trigger.
            run = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("ST1_live_sinr", f"WITH {EV} SELECT (k + 2) / 2.0::DOUBLE - 23 AS dl_sinr, count(*) AS rows FROM ev WHERE event_type = 'signup' GROUP BY 1")
def live_sinr(spark, sf_dir):
    lines = metrics.log_stream(spark, f"{written_log(spark, sf_dir)}/*")
    return _drain(metrics.live_sinr(lines), "sinr").groupBy("dl_sinr").agg(F.count(F.lit(1)).alias("rows"))


@query("ST2_feedback_join", f"""WITH {EV}, m AS (SELECT t.pos, f.pos AS fpos FROM etx t LEFT JOIN efb f ON t.ue_id = f.ue_id AND f.ts >= t.ts AND f.ts <= t.ts + INTERVAL 12 HOUR)
SELECT count(fpos) AS matched, count(DISTINCT pos) FILTER (fpos IS NOT NULL) AS answered, count(*) FILTER (fpos IS NULL) AS unmatched FROM m""")
def feedback_join(spark, sf_dir):
    tx, fb = event_transmissions(spark, sf_dir), event_feedback(spark, sf_dir)
    # The closing rows of both sides lie behind all windows and wait there themselves.
    joined = feedback.feedback_join(
        _table_stream(tx, "tx", "ts", _after(tx, "90 days", ue_id=-1)), _table_stream(fb, "fb", "ts", _after(fb, "90 days", ue_id=-2)),
        "12 hours", "1 hour",
    )
    out = _drain(joined, "joined").where(F.col("ue_id") >= 0)
    hit = F.col("harq_timestamp").isNotNull()
    return out.agg(
        F.count(F.when(hit, 1)).alias("matched"), F.count_distinct(F.when(hit, F.col("pos"))).alias("answered"),
        F.count(F.when(~hit, 1)).alias("unmatched"),
    )


@query("ST2_consuming_feedback", f"""WITH RECURSIVE {CONSUMED}
SELECT t.pos AS tx_seq, m.fb_pos AS fb_seq FROM etx t LEFT JOIN matched m ON m.tx_pos = t.pos AND m.retired""")
def consuming_feedback(spark, sf_dir):
    """Streamed consuming feedback to the end of its input: every transmission with the feedback that retired it."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase"))
    rows = e.select(
        F.col("ue_id").cast("long").alias("series"), "ts", F.unix_micros("ts").alias("us"), F.col("pos").alias("seq"),
        (F.col("event_type") == "click").alias("is_tx"),
    )
    stream = _table_stream(rows, "links", "ts", _after(rows, "90 days", series=-1, is_tx=True))
    out = _drain(state.consuming_feedback(stream, EVENT_WINDOW_MS, "1 hour"), "consumed")
    return out.where(F.col("series") >= 0).select("tx_seq", "fb_seq")


@query("ST3_per_second", f"""WITH {EV}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, sum(tbs) AS tbs, count(*) AS rows FROM etx GROUP BY 1)
SELECT window_start, tbs * 8 / 1024 / 1000 AS throughput_mbps, rows FROM w""", "throughput_mbps", digits=10)
def per_second(spark, sf_dir):
    tx = event_transmissions(spark, sf_dir).withColumn("ack_status", F.lit(1.0))
    out = _drain(metrics.per_second(_table_stream(tx, "rates", "ts", _after(tx, "1 day")), "ts", "1 hour", "1 hour"), "windows")
    return out.select("window_start", "throughput_mbps", "rows")


@query("ST4_running_error_rate", f"WITH {TX} SELECT ue_id, count(*) AS rows, avg(CAST(ack_status = 0 AS DOUBLE) * 100) AS bler FROM tx GROUP BY 1", "bler")
def running_error_rate(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select("ue_id", "ack_status")
    return _drain(metrics.running_error_rate(_table_stream(tx, "acks", "ue_id"), ["ue_id"]), "running", "complete")


@query("ST4_rolling_error_rate", f"""WITH {EV} SELECT ue_id AS series, pos AS seq, avg(CAST(k % 3 = 0 AS INTEGER)) OVER (PARTITION BY ue_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS bler FROM ev""", "bler")
def rolling_error_rate(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        F.col("ue_id").cast("long").alias("series"), F.col("pos").alias("seq"), (F.pmod("k", F.lit(3)) == 0).cast("int").alias("error")
    )
    return _drain(state.rolling_error_rate(_table_stream(rows, "bits", "seq"), 5), "rolling")


@query("ST5_streamed_features", f"WITH {TX} SELECT mcs, count(*) AS rows, CAST(sum(CAST(bler <= target_bler AND blkerr = 1 AS INTEGER)) AS BIGINT) AS passes FROM tx GROUP BY 1")
def streamed_features(spark, sf_dir):
    raw = transmissions(spark, sf_dir).select(
        F.col("snr").cast("string").alias("SNR"), F.col("mcs").cast("string").alias("MCS"), F.col("bler").cast("string").alias("BLER"),
        F.col("target_bler").cast("string").alias("Targetbler"), F.col("blkerr").cast("string").alias("BLKErr"),
    )
    out = _drain(metrics.featurize(_table_stream(raw, "slots")), "features")
    return out.groupBy("mcs").agg(F.count(F.lit(1)).alias("rows"), F.sum("label_pass").alias("passes"))


@query("ST5_resumed_features", f"WITH {TX} SELECT mcs, count(*) AS rows, CAST(sum(CAST(bler <= target_bler AND blkerr = 1 AS INTEGER)) AS BIGINT) AS passes FROM tx GROUP BY 1")
def resumed_features(spark, sf_dir):
    """Features of slots that arrive in two parts, by a query that ends after the first and goes on from its checkpoint."""
    raw = transmissions(spark, sf_dir).select(
        F.col("snr").cast("string").alias("SNR"), F.col("mcs").cast("string").alias("MCS"), F.col("bler").cast("string").alias("BLER"),
        F.col("target_bler").cast("string").alias("Targetbler"), F.col("blkerr").cast("string").alias("BLKErr"),
        F.pmod(F.xxhash64(*ROW_KEY), F.lit(3)).alias("part"),
    )
    arrived, path, check = (scratch_path(spark, label) for label in ("arrived", "resumed", "resumed-state"))
    for part in (F.col("part") == 0, F.col("part") > 0):
        raw.where(part).drop("part").write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(raw.drop("part").schema).option("maxFilesPerTrigger", 2).parquet(arrived)
        out = metrics.featurize(stream)
        sinks.keyed_writer(out, path, check).trigger(availableNow=True).start().awaitTermination()
    found = sinks.read_keyed(spark, path, out.schema)
    return found.groupBy("mcs").agg(F.count(F.lit(1)).alias("rows"), F.sum("label_pass").alias("passes"))


@query("ST6_offset_loop", "SELECT count(*) AS rows, 0::BIGINT AS differing FROM lineitem")
def offset_loop(spark, sf_dir):
    """Streamed offset loop; rows where it differs from the batch replay are counted."""
    seq = F.xxhash64(*ROW_KEY)
    df = scored(spark, sf_dir, unrolled=True).select(seq.alias("seq"), F.col("ue_id").cast("long").alias("series"), "cqi", "cand")
    # Stored, since a range partitioning reads its input twice.
    masked = materialize(df.withColumn("mask", replay.success_mask(F.lit(0.9))).drop("cand"), "masks")
    streamed = _drain(state.offset_loop(_table_stream(masked, "olla", "seq")), "offset")
    batch = replay.olla(df, ["series"], ["seq"]).select("series", "seq", "olla_mcs")
    both = streamed.join(batch, ["series", "seq"], "full")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("mcs").eqNullSafe(F.col("olla_mcs"))).cast("int")).alias("differing"))


@query("ST6_allocator", "SELECT count(*) AS rows, 0::BIGINT AS differing FROM lineitem")
def allocator(spark, sf_dir):
    rows = transmissions(spark, sf_dir).select(
        F.xxhash64(*ROW_KEY).alias("seq"), F.col("ue_id").cast("long").alias("series"), "cqi", "bler"
    )
    streamed = _drain(state.allocator(_table_stream(rows, "alloc", "seq"), 0.05), "allocated")
    batch = replay.allocator(rows, ["series"], ["seq"], 0.05, out="batch_cqi").select("series", "seq", "batch_cqi")
    both = streamed.join(batch, ["series", "seq"], "full")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("alloc_cqi").eqNullSafe(F.col("batch_cqi"))).cast("int")).alias("differing"))


@query("ST7_violation_rate", f"""WITH {TX}, w AS (SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, avg(1 - label_pass) AS violation, count(*) AS rows FROM tx GROUP BY 1)
SELECT * FROM w""", "violation")
def violation_rate(spark, sf_dir):
    tx = transmissions(spark, sf_dir).select("ts", "label_pass")
    return _drain(metrics.violation_rate(_table_stream(tx, "labels", "ts", _after(tx, "90 days")), "ts", "1 day", "30 days"), "violations")
