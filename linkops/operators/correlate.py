"""Joining transmissions with feedback and with measurements.

Event frames carry ``file, block, pos`` (log order), ``ts`` and the link keys ``ue_id, rnti, harq_id``.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import radio
from ..functions.expr import micros, seconds_between
from ..session import materialize, small_side
from .joins import null_safe_join
from .ordered import chunked, halo_blocks, row_numbers, segments

LINK_KEYS = ("file", "ue_id", "rnti", "harq_id")
LOG_ORDER = ("block", "pos")
BUCKET_US = 10_000


def _bucket(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us)).cast("bigint")


def first_feedback(tx: DataFrame, fb: DataFrame, window_ms: float = 50, keys=LINK_KEYS,
                   order=LOG_ORDER) -> DataFrame:
    """Each transmission with the first feedback in log order 0..window after it; feedback is reusable.

    A time bucket of one window joins the keys as an equality, so a busy link is spread over time and never
    pairs all with all. Feedback is first reduced to one row per link and microsecond. Transmissions without
    feedback stay, with nulls.
    """
    width = int(window_ms * 1000)
    fb_once = fb.groupBy(*keys, micros("ts").alias("_ft")).agg(
        F.min_by(F.struct(F.col("ts").alias("harq_timestamp"), "ack"), F.struct(*order)).alias("_fb"),
        F.min(F.struct(*order)).alias("_fo"),
    )
    own = _bucket(F.col("_ft"), width)
    fb_side = fb_once.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_ft", "_fb", "_fo",
        F.explode(F.array(own, own - 1)).alias("_fbucket"),
    )
    tx_side = tx.withColumn("_t", micros("ts")).withColumn("_bucket", _bucket(F.col("_t"), width))
    match = (F.col("_bucket") == F.col("_fbucket")) & F.col("_ft").between(F.col("_t"), F.col("_t") + width)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    joined = tx_side.join(fb_side, match, "left")
    rest = [c for c in tx.columns if c not in (*keys, *order)]
    # Grouping starts with the join keys, so it needs no further shuffle.
    best = joined.groupBy(*keys, "_bucket", *order).agg(
        *[F.first(c).alias(c) for c in rest],
        F.min_by(F.struct("_fb", "_ft"), F.col("_fo")).alias("_best"), F.first("_t").alias("_t"),
    )
    return best.select(
        *tx.columns,
        F.col("_best._fb.harq_timestamp").alias("harq_timestamp"),
        F.col("_best._fb.ack").alias("ack"),
        ((F.col("_best._ft") - F.col("_t")) / 1000).alias("time_diff_ms"),
    )


class _Matcher:
    """Pending transmissions of one link in time order; feedback takes the newest bucket, earliest row in it."""

    def __init__(self, window_us: int):
        self.window = window_us
        self.pending: deque = deque()

    def expire(self, now: int):
        while self.pending and self.pending[0][0] < now - self.window:
            self.pending.popleft()

    def send(self, us: int, row: int):
        self.pending.append((us, row))

    def feedback(self, us: int):
        self.expire(us)
        if not self.pending:
            return None
        newest = self.pending[-1][0] // BUCKET_US
        at = len(self.pending) - 1
        while at > 0 and self.pending[at - 1][0] // BUCKET_US == newest:
            at -= 1
        taken = self.pending[at]
        del self.pending[at]
        return taken

    def state(self, now: int):
        self.expire(now)
        return list(self.pending)


_MATCHES = "_block bigint, tx_row bigint, fb_row bigint, retired boolean, resolved boolean"


def _match_block(window_us: int, lag: int, size: int, keys):
    """Matcher of the links in one block; the halo before the block only establishes the pending set.

    Pending sets are ordered: a run that starts with more pending transmissions always keeps a superset. So a
    run from nothing and a run from everything enclose the true one; once they agree at the block start, the
    state is known exactly. Otherwise the block is reported unresolved.
    """

    columns = ["_block", "tx_row", "fb_row", "retired", "resolved"]

    def link(rows, block, halo_start):
        """Matches of one link, or None when its state at the block start is not known."""
        body = next((i for i, r in enumerate(rows) if not r[3]), len(rows))
        if body == len(rows):
            return []
        low, high = _Matcher(window_us), _Matcher(window_us)
        known = rows[0][0] > halo_start or halo_start == 0
        start = 0
        if not known:
            horizon = rows[0][1] + window_us
            start = next((i for i, r in enumerate(rows) if r[1] > horizon), len(rows))
            for row, us, is_tx, _ in rows[:start]:
                if is_tx:
                    high.send(us, row)
        if start > body:
            return None
        for row, us, is_tx, _ in rows[start:body]:
            for side in (low, high):
                if is_tx:
                    side.send(us, row)
                else:
                    side.feedback(us)
        now = rows[body][1]
        if not known and low.state(now) != high.state(now):
            return None
        same_time = [(us, row) for row, us, is_tx, _ in rows[:body] if not is_tx and us == now]
        out = []
        for row, us, is_tx, _ in rows[body:]:
            same_time = [f for f in same_time if f[0] == us]
            if is_tx:
                # Feedback logged earlier at the same instant also answers, without retiring the transmission.
                if same_time:
                    out.append((block, row, same_time[0][1], False, True))
                low.send(us, row)
            else:
                taken = low.feedback(us)
                if taken:
                    out.append((block, taken[1], row, True, True))
                same_time.append((us, row))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        block = int(pdf["_block"].iloc[0])
        halo_start = max(0, block * size - lag)
        rows = list(zip(pdf["_row"].tolist(), pdf["_us"].tolist(), pdf["_tx"].tolist(), pdf["_halo"].tolist()))
        out = []
        for begin, end in segments(pdf, keys):
            matches = link(rows[begin:end], block, halo_start)
            if matches is None:
                return pd.DataFrame([(block, None, None, False, False)], columns=columns)
            out += matches
        return pd.DataFrame(out, columns=columns)

    return run


def _halo_of(numbered: DataFrame, blocks: DataFrame, lag: int, size: int) -> DataFrame:
    """The rows of the given blocks with the ``lag`` rows before each; no other row is copied."""
    first = F.greatest(F.col("_block") - F.lit(-(-lag // size)), F.lit(0))
    wanted = blocks.select("_block", F.explode(F.sequence(first, F.col("_block"))).alias("_own"))
    rows = numbered.withColumn("_own", F.floor(F.col("_row") / F.lit(size)).cast("bigint")).join(small_side(wanted), "_own")
    return rows.where(F.col("_row") >= F.col("_block") * size - lag).withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own")


def consuming_matches(tx: DataFrame, fb: DataFrame, window_ms: float = 50, keys=LINK_KEYS, order=LOG_ORDER,
                      block_rows: int = 100_000, halo_rows: int = 2_000):
    """One-to-one matching where feedback retires a transmission. Returns ``(numbered events, matches)``.

    Events are ordered by time, then log order. Links are cut into blocks of ``block_rows`` events, also inside
    one busy link; blocks whose incoming state the halo cannot prove run again with a longer halo, which in the
    end reaches the start of the link.
    """
    keys = list(keys)
    events = tx.withColumn("_tx", F.lit(True)).unionByName(fb.withColumn("_tx", F.lit(False)), allowMissingColumns=True)
    events = events.withColumn("_us", micros("ts"))
    numbered = materialize(
        row_numbers(chunked(events, keys, ["_us", *order, "_tx"])).drop("_chunk", "_idx"), "events"
    )
    slim = numbered.select("_row", "_us", "_tx", *keys)
    width, lag, todo, parts = int(window_ms * 1000), halo_rows, None, []
    while True:
        blocks = halo_blocks(slim, lag, block_rows) if todo is None else _halo_of(slim, todo, lag, block_rows)
        found = materialize(
            blocks.groupBy("_block").applyInPandas(_match_block(width, lag, block_rows, keys), _MATCHES), "matches"
        )
        parts.append(found.where("resolved"))
        open_blocks = found.where(~F.col("resolved")).select("_block").distinct()
        if open_blocks.isEmpty():
            break
        # Such a block runs again whole.
        parts[-1] = found.join(small_side(open_blocks), "_block", "left_anti")
        todo, lag = materialize(open_blocks, "open"), lag * 8
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.unionByName(part)
    return numbered, matches.drop("_block", "resolved")


def consuming_feedback(tx: DataFrame, fb: DataFrame, window_ms: float = 50, keys=LINK_KEYS, order=LOG_ORDER,
                       compat_duplicate_unmatched: bool = False, **blocks) -> DataFrame:
    """Transmissions with consumed feedback; those never retired also appear unmatched (once).

    ``compat_duplicate_unmatched`` emits unmatched transmissions twice.
    """
    numbered, matches = consuming_matches(tx, fb, window_ms, keys, order, **blocks)
    sent = numbered.where("_tx").select(F.col("_row").alias("tx_row"), *tx.columns)
    answers = numbered.where(~F.col("_tx")).select(
        F.col("_row").alias("fb_row"), F.col("ts").alias("harq_timestamp"), "ack"
    )
    matched = sent.join(matches.select("tx_row", "fb_row"), "tx_row").join(answers, "fb_row").drop("fb_row")
    free = sent.join(matches.where("retired").select("tx_row"), "tx_row", "left_anti").withColumns({
        "harq_timestamp": F.lit(None).cast("timestamp"), "ack": F.lit(None).cast("int"),
    })
    out = matched.unionByName(free)
    if compat_duplicate_unmatched:
        out = out.unionByName(free)
    return out.withColumn("time_diff_ms", seconds_between("harq_timestamp", "ts") * 1000).select(
        *tx.columns, "harq_timestamp", "ack", "time_diff_ms"
    )


def label_feedback(correlated: DataFrame, unmatched: str = "dtx") -> DataFrame:
    """Status columns; unmatched rows become DTX/2.0 (``dtx``) or UNKNOWN/null (``unknown``)."""
    if unmatched not in ("dtx", "unknown"):
        raise ValueError(unmatched)
    status, text = (F.lit(2.0), "DTX") if unmatched == "dtx" else (F.lit(None).cast("double"), "UNKNOWN")
    return correlated.withColumns({
        "ack_status": F.coalesce(F.col("ack").cast("double"), status),
        "ack_result": F.when(F.col("ack").isNull(), text).otherwise(radio.ack_text("ack")),
        "transmission_type": radio.transmission_type("nrtx"),
    })


def unmatched_transmissions(tx: DataFrame, fb: DataFrame, window_ms: float = 50, keys=LINK_KEYS,
                            order=LOG_ORDER) -> DataFrame:
    """Transmissions without any feedback in the window (anti join on time buckets)."""
    width = int(window_ms * 1000)
    own = _bucket(micros("ts"), width)
    fb_side = fb.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], micros("ts").alias("_ft"),
        F.explode(F.array(own, own - 1)).alias("_fbucket"),
    ).distinct()
    t = micros("ts")
    match = (_bucket(t, width) == F.col("_fbucket")) & F.col("_ft").between(t, t + width)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    return tx.join(fb_side, match, "left_anti")


def nearest_measurement(tx: DataFrame, meas: DataFrame, value: str, window_s: float = 1.0, keys=("file",),
                        order=LOG_ORDER) -> DataFrame:
    """Transmissions with the closest measurement at most ``window_s`` away; equal distances take the earliest logged.

    Both sides shrink to distinct instants, measurements are copied to the neighbouring time buckets, and each
    bucket is scanned forward and backward once. A bucket never holds more than its count of microseconds.
    """
    keys = list(keys)
    width = int(window_s * 1_000_000)
    instants = tx.select(*keys, micros("ts").alias("_t")).distinct().withColumn("_bucket", _bucket(F.col("_t"), width))
    points = meas.groupBy(*keys, micros("ts").alias("_t")).agg(
        F.min(F.struct(F.struct(*order).alias("o"), F.col(value).alias("v"))).alias("_first")
    ).select(*keys, "_t", F.struct("_t", F.col("_first.o").alias("o"), F.col("_first.v").alias("v")).alias("_m"))
    home = _bucket(F.col("_t"), width)
    copies = points.withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))
    both = instants.withColumn("_m", F.lit(None).cast(points.schema["_m"].dataType)).unionByName(copies)
    rank = F.col("_m").isNull().cast("int")
    forward = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_t"), rank)
    backward = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_t").desc(), rank)
    span = (Window.unboundedPreceding, 0)
    seen = both.withColumns({
        "_prev": F.last("_m", ignorenulls=True).over(forward.rowsBetween(*span)),
        "_next": F.last("_m", ignorenulls=True).over(backward.rowsBetween(*span)),
    }).where(F.col("_m").isNull())

    def candidate(c):
        gap = F.abs(F.col(f"{c}._t") - F.col("_t"))
        return F.when(gap <= width, F.struct(gap.alias("gap"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.v").alias("v")))

    near = seen.select(*keys, "_t", F.least(candidate("_prev"), candidate("_next")).alias("_best"))
    near = near.where(F.col("_best").isNotNull()).withColumnRenamed("_t", "_nt")
    keyed = tx.withColumn("_nt", micros("ts"))
    return keyed.join(near, [*keys, "_nt"]).select(
        *tx.columns, F.col("_best.v").alias(value), (F.col("_best.gap") / 1e6).alias("time_diff")
    )


def mcs_sinr_pairs(tx_wide: DataFrame, sinr: DataFrame, window_s: float = 1.0) -> DataFrame:
    """Wide transmissions paired with the closest CRC SINR."""
    paired = nearest_measurement(tx_wide, sinr, "actual_sinr", window_s)
    return paired.select(
        F.col("ts").alias("timestamp"), "ue_id", "mcs", "tbs", (F.col("rb_end") - F.col("rb_start")).alias("rb_count"),
        F.col("actual_sinr").alias("sinr_db"), "time_diff",
    )


def bucket_measurement(tx: DataFrame, meas: DataFrame, values, bucket_s: int = 30, keys=("file",),
                       order=LOG_ORDER) -> DataFrame:
    """First measurement logged in the same time bucket, else of the bucket before, else of the one after.

    The three choices become one small table keyed by bucket, so transmissions are joined once.
    """
    keys = list(keys)
    bucket = F.floor(F.unix_micros("ts") / F.lit(bucket_s * 1_000_000)).cast("bigint")
    firsts = meas.groupBy(*keys, bucket.alias("_b")).agg(
        F.min_by(F.struct(*values), F.struct(*order)).alias("_m")
    )
    offers = firsts.select(*keys, "_m", F.explode(F.array(
        F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("pref")),
        F.struct((F.col("_b") + 1).alias("bucket"), F.lit(1).alias("pref")),
        F.struct((F.col("_b") - 1).alias("bucket"), F.lit(2).alias("pref")),
    )).alias("_o"))
    table = offers.groupBy(*keys, F.col("_o.bucket").alias("_b")).agg(F.min_by("_m", F.col("_o.pref")).alias("_m"))
    joined = tx.withColumn("_b", bucket).join(table, [*keys, "_b"], "left")
    return joined.select(*tx.columns, *[F.col(f"_m.{v}").alias(v) for v in values])


def zip_tables(left: DataFrame, right: DataFrame, left_order: str, right_order: str, lv: str, rv: str) -> DataFrame:
    """Pair two tables by position, up to the shorter one, with the difference left minus right.

    Positions come from chunk counts, so neither table is numbered in one task.
    """
    def numbered(df, order, value, name):
        rows = row_numbers(chunked(df.select(F.col(order).alias("_o"), F.col(value).alias(name)), [], ["_o"]))
        return rows.select((F.col("_row") + 1).alias("position"), name)

    a, b = numbered(left, left_order, lv, "left_value"), numbered(right, right_order, rv, "right_value")
    return a.join(b, "position").withColumn("difference", F.col("left_value") - F.col("right_value"))


def scenario_grid(spark, targets, windows, altitudes, seeds) -> DataFrame:
    """Every combination of the four parameter lists."""
    def values(name, items, kind):
        return F.explode(F.array(*[F.lit(v).cast(kind) for v in items])).alias(name)

    grid = spark.range(1).select(values("target_bler", targets, "double"))
    grid = grid.select("*", values("bler_window", windows, "int"))
    grid = grid.select("*", values("altitude_m", altitudes, "double"))
    return grid.select("*", values("seed", seeds, "int"))


def back_join_totals(df: DataFrame, keys, totals: dict[str, Column]) -> DataFrame:
    """Group totals on every row: partial aggregation, then a join on the (small) totals.

    Unlike a window this does not gather a large group in one task.
    """
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return null_safe_join(df, small_side(sums), list(keys), "left")

