"""Sequential operators against plain loops, with blocks far smaller than a series."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkops.operators import candidates, correlate, ordered, quantiles, replay

T0 = datetime(2025, 1, 1)


def brute_consume(events, window_us):
    """Log-order matcher: newest 10 ms bucket first, earliest row inside it."""
    pending, answered, out, retired = {}, {}, [], set()
    for us, key, pos, is_tx in events:
        if is_tx:
            for fus, fpos in answered.get(key, []):
                if 0 <= fus - us <= window_us:
                    out.append((pos, fpos))
                    break
            pending.setdefault(key, []).append((us, pos))
        else:
            answered.setdefault(key, []).append((us, pos))
            live = [r for r in pending.get(key, []) if 0 <= us - r[0] <= window_us]
            if live:
                newest = max(r[0] // 10_000 for r in live)
                taken = next(r for r in live if r[0] // 10_000 == newest)
                pending[key].remove(taken)
                retired.add(taken[1])
                out.append((taken[1], pos))
    return sorted(out), retired


def _events(n, seed, keys, gap_us):
    rng, us, rows = random.Random(seed), 0, []
    for i in range(n):
        us += rng.choice([0, 0, gap_us, 3 * gap_us])
        rows.append((us, rng.randrange(keys), i, rng.random() < 0.55))
    return rows


def test_consuming_feedback_in_small_blocks(spark):
    for seed, keys, halo in ((1, 1, 40), (2, 3, 5), (3, 1, 1)):
        rows = _events(600, seed, keys, 4_000)
        expected, retired = brute_consume(rows, 50_000)
        frame = spark.createDataFrame(
            [("f", 0, p, T0 + timedelta(microseconds=us), k, 1, 0, is_tx) for us, k, p, is_tx in rows],
            "file string, block bigint, pos bigint, ts timestamp, ue_id int, rnti int, harq_id int, is_tx boolean",
        )
        tx = frame.where("is_tx").drop("is_tx").withColumns({"mcs": F.lit(1), "tbs": F.lit(10), "nrtx": F.lit(0)})
        fb = frame.where("not is_tx").drop("is_tx").withColumn("ack", F.pmod("pos", F.lit(3)).cast("int"))
        out = correlate.consuming_feedback(tx, fb, 50, block_rows=64, halo_rows=halo).collect()
        got = sorted((r.pos, r.ack) for r in out if r.harq_timestamp is not None)
        assert got == sorted((a, b % 3) for a, b in expected)
        free = {r.pos for r in out if r.harq_timestamp is None}
        assert free == {p for _, _, p, is_tx in rows if is_tx} - retired


def test_offset_loop_in_small_blocks(spark):
    rng = random.Random(5)
    # Arbitrary success bits, not falling with MCS.
    rows = [(i % 2 if i > 700 else 0, i, rng.randrange(16), rng.getrandbits(28) if i % 3 else (1 << 28) - 1) for i in range(1500)]
    machine = replay.offset_loop(1.0, 0.3, 2.0)
    df = spark.createDataFrame(rows, "s int, i int, cqi int, _mask int")
    got = {(r.s, r.i): r.m for r in replay.replay(df, ["s"], ["i"], machine, "m", 100).collect()}
    state = {}
    for s, i, cqi, mask in rows:
        n, failures = state.get(s, (0, 0))
        mcs = min(max(round(cqi + 2.0 + 0.3 * n - 1.0 * failures), 0), 27)
        assert got[(s, i)] == mcs
        state[s] = (n + 1, failures + 1 - ((mask >> mcs) & 1))


def test_allocator_in_small_blocks(spark):
    rng = random.Random(6)
    rows = [(0, i, rng.randrange(16), rng.choice([0.0, 0.01, 0.05, 0.2])) for i in range(500)]
    df = spark.createDataFrame(rows, "s int, i int, cqi int, bler double")
    got = {r.i: r.alloc_cqi for r in replay.allocator(df, ["s"], ["i"], 0.05, block_rows=30).collect()}
    current = 1
    for _, i, cqi, bler in rows:
        if bler > 0.05:
            nxt = cqi
        elif bler < 0.05 and cqi != current:
            nxt = max(cqi, current)
        elif bler == 0:
            nxt = cqi + 1
        else:
            nxt = cqi
        current = min(max(nxt, 1), 15)
        assert got[i] == current


def test_windows_do_not_depend_on_chunks(spark):
    rows = [(i % 3 if i > 400 else 0, i, (i * 37) % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "s int, i int, v int")
    for chunks in (1, 13):
        run = {(r.s, r.i): r.c for r in ordered.running_sums(df, ["s"], ["i"], {"c": F.col("v")}, chunks).collect()}
        total = {}
        for s, i, v in rows:
            total[s] = total.get(s, 0) + v
            assert run[(s, i)] == total[s]
    out = {(r.s, r.i): r.m for r in ordered.trailing(df, ["s"], ["i"], {"m": ("v", 7)}, block_rows=16).collect()}
    seen = {}
    for s, i, v in rows:
        seen.setdefault(s, []).append(v)
        last = seen[s][-7:]
        assert abs(out[(s, i)] - sum(last) / len(last)) < 1e-12


def test_quantiles_of_a_skewed_group(spark):
    df = spark.createDataFrame([(0, 1.0)] * 500 + [(0, float(i)) for i in range(100)] + [(1, 5.0), (1, 7.0)], "k int, x double")
    got = {(r.k, r.q): r.x for r in quantiles.grouped_quantiles(df, ["k"], "x", [0.0, 0.5, 0.9, 1.0]).collect()}
    import numpy as np

    base = np.array([1.0] * 500 + list(range(100)))
    for q in (0.0, 0.5, 0.9, 1.0):
        assert abs(got[(0, q)] - np.quantile(base, q)) < 1e-12
        assert abs(got[(1, q)] - np.quantile([5.0, 7.0], q)) < 1e-12


def test_policy_ties_and_fallbacks(spark):
    from linkops.operators import policy

    df = candidates.candidates(spark.range(1), lambda m: F.when(m == 3, 0.5).when(m == 9, 0.5).otherwise(0.1))
    row = df.select(
        policy.threshold_choice(0.5)["mcs"], policy.threshold_choice(0.9)["mcs"], policy.threshold_choice(0.9, fallback="min_zero")["p"],
        policy.guardrailed_choice(0.9)["mcs"], policy.best_probability()["mcs"],
    ).first()
    assert tuple(row) == (9, 3, 0.0, 0, 3)
    flat = candidates.candidates(spark.range(1), lambda m: F.lit(0.0)).select(policy.throughput_choice()["mcs"]).first()[0]
    assert flat == 0
