"""Streams that stop and go on, links that go idle, and the ring behind the rolling rate."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from linkops.streaming import metrics, sinks, state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = datetime(2025, 1, 1)


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Map:
    def __init__(self):
        self.held, self.touched = {}, 0

    def containsKey(self, key):
        self.touched += 1
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.touched += 1
        self.held[key] = value

    def clear(self):
        self.held = {}


class _Handle:
    def getValueState(self, name, schema):
        return _Value()

    def getMapState(self, name, key, value):
        return _Map()


def rates(errors, width):
    out = []
    for i in range(len(errors)):
        last = errors[max(0, i - width):i]
        out.append(sum(last) / len(last) if last else None)
    return out


@pytest.mark.parametrize("width", [1, 5, 1000, 1024, 2500, 5000])
def test_rolling_rate_in_batches_of_any_size(width):
    pick = random.Random(width)
    errors = [int(pick.random() < 0.3) for _ in range(9_000)]
    link = state._RollingError(width)
    link.init(_Handle())
    at, got = 0, []
    while at < len(errors):
        n = pick.choice([1, 2, 3, 50, 700, 3_000])
        part = errors[at:at + n]
        got += link.advance((1,), pd.DataFrame({"seq": np.arange(at, at + len(part)), "error": part}))["bler"].tolist()
        at += n
    assert got == rates(errors, width)


def test_cost_of_a_rolling_rate_does_not_grow_with_the_window():
    touched = []
    for width in (100, 50_000):
        link = state._RollingError(width)
        link.init(_Handle())
        link.advance((1,), pd.DataFrame({"seq": np.arange(60_000), "error": np.ones(60_000, int)}))
        before = link.pages.touched
        link.advance((1,), pd.DataFrame({"seq": np.arange(60_000, 60_010), "error": np.zeros(10, int)}))
        touched.append(link.pages.touched - before)
    assert max(touched) <= 6


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _files(spark, path, batches, schema):
    """One file for each batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda f: f.getModificationTime())
    start = parts[0].getModificationTime()
    for i, f in enumerate(parts):
        fs.setTimes(f.getPath(), start + 1000 * i, -1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_idle_links_leave_the_store(spark, rocks, tmp_path):
    schema = "series long, seq long, error int, ts timestamp"
    hour = timedelta(hours=1)
    first = [(s, i, i % 2, T0 + timedelta(minutes=i)) for s in range(20) for i in range(4)]
    later = [(99, 100 + i, 0, T0 + 10 * hour + i * hour) for i in range(3)]
    back = [(3, 200, 1, T0 + 14 * hour), (3, 201, 0, T0 + 14 * hour)]
    stream = _files(spark, f"{tmp_path}/in", [first, later, later[:1], back], schema)
    out = state.rolling_error_rate(stream, 3, idle_ms=2 * 3600 * 1000, delay="1 minute")
    query = out.writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < held[0] / 2
    rows = {(r["series"], r["seq"]): r["bler"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows[0, 3] == pytest.approx(1 / 3) and rows[3, 0] is None
    assert rows[3, 200] is None and rows[3, 201] == 1.0  # forgotten, and begun anew


def test_state_stays_without_an_idle_time(spark, rocks, tmp_path):
    schema = "series long, seq long, cqi int, mask long"
    batches = [[(s, 10 * k + i, 7, (1 << 28) - 1) for s in range(3) for i in range(5)] for k in range(3)]
    out = state.offset_loop(_files(spark, f"{tmp_path}/in", batches, schema), 1.0, 0.5)
    out.writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["seq"], r["mcs"]) for r in spark.read.parquet(f"{tmp_path}/out").where("series = 1").collect())
    assert [m for _, m in got] == [min(27, max(0, round(7 + 0.5 * n))) for n in range(15)]


@pytest.mark.parametrize("when", ["before writing", "after writing"])
def test_a_stopped_query_goes_on_without_loss_or_repeats(spark, tmp_path, when):
    """The query dies in its third micro-batch, before or after that batch is written, and starts again."""
    schema = "SNR string, MCS string, BLER string, Targetbler string, BLKErr string"
    batches = [[(f"{k}.5", str((k * 7 + i) % 28), "0.05", "0.1", str(i % 2)) for i in range(40)] for k in range(6)]
    stream = metrics.featurize(_files(spark, f"{tmp_path}/in", batches, schema))
    whole, stopped = (f"{tmp_path}/{name}" for name in ("whole", "stopped"))
    sinks.keyed_writer(stream, whole, f"{whole}-state").trigger(availableNow=True).start().awaitTermination()
    writer, calls = sinks.keyed_writer(stream, stopped, f"{stopped}-state"), []

    def dies(rows, batch):
        calls.append(batch)
        if batch == 2 and when == "before writing":
            raise RuntimeError("lost")
        rows.write.mode("overwrite").parquet(f"{stopped}/batch_id={batch}")
        if batch == 2:
            raise RuntimeError("lost")

    dying = stream.writeStream.option("checkpointLocation", f"{stopped}-state").foreachBatch(dies).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        dying.awaitTermination()
    assert calls == [0, 1, 2]
    writer.trigger(availableNow=True).start().awaitTermination()
    tables = [sinks.read_keyed(spark, path, stream.schema) for path in (whole, stopped)]
    assert tables[0].count() == 240 and tables[0].exceptAll(tables[1]).count() == 0 and tables[1].exceptAll(tables[0]).count() == 0
    counts = {r["batch_id"]: r["rows"] for r in sinks.batch_counts(spark, stopped, stream.schema).collect()}
    assert counts == {k: 40 for k in range(6)}


def test_an_unfinished_folder_is_not_read(spark, tmp_path):
    path = f"{tmp_path}/sink"
    df = spark.range(5)
    df.write.parquet(f"{path}/batch_id=0")
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch_id=1")
    assert sinks.read_keyed(spark, path, df.schema).count() == 5
    assert sinks.read_keyed(spark, f"{tmp_path}/none", df.schema).count() == 0


def test_live_sinr_goes_on_from_its_checkpoint(spark, tmp_path):
    lines = f"{tmp_path}/log"
    out, check = f"{tmp_path}/out", f"{tmp_path}/state"
    want = []
    for part in range(3):
        values = [part * 10 + i for i in range(5)]
        want += values
        spark.createDataFrame([(f'"sinr": {v}',) for v in values] + [("other",)], "value string").coalesce(1).write.mode("append").text(lines)
        stream = metrics.live_sinr(metrics.log_stream(spark, lines))
        sinks.keyed_writer(stream, out, check).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["dl_sinr"] for r in sinks.read_keyed(spark, out, stream.schema).collect())
    assert len(got) == 15 and got == sorted(v / 2 - 23 for v in want)


def test_a_trigger_has_a_file_a_core(spark, tmp_path):
    """Triggers keep the order of the rows, and none of them is read by one task."""
    from linkops.catalog.streams import _table_stream

    rows = spark.range(20_000).selectExpr("id * 7919 % 20000 AS at")
    last = spark.createDataFrame([(50_000,)], "at long")
    seen = []

    def look(batch, _):
        seen.append((batch.rdd.getNumPartitions(), sorted(r["at"] for r in batch.collect())))

    stream = _table_stream(rows, "rows", "at", last, files=4)
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert [at for _, part in seen for at in part] == [*range(20_000), 50_000]
    assert len(seen) == 5 and all(tasks > 1 for tasks, _ in seen[:4])


def consumed(rows, window_us):
    """``tx: fb`` of rows of one link in order, by looking at all that waits."""
    waiting, out = [], {}
    for us, seq, is_tx in sorted(rows):
        out |= {s: None for u, s in waiting if u < us - window_us}
        waiting = [r for r in waiting if r[0] >= us - window_us]
        if is_tx:
            waiting.append((us, seq))
        elif waiting:
            at = next(i for i, r in enumerate(waiting) if r[0] // 10_000 == waiting[-1][0] // 10_000)
            out[waiting.pop(at)[1]] = seq
    return out | {s: None for _, s in waiting}


def test_links_of_consuming_feedback_share_keys(spark, rocks, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 4)
    pick, links, batches = random.Random(5), {}, []
    for k in range(4):
        batch = []
        for link in [*range(60), None]:
            for _ in range(12):
                us, seq, is_tx = k * 1_000_000 + pick.randrange(0, 900_000, 3_000), len(links), pick.random() < 0.6
                links[seq] = (link, us, is_tx)
                batch.append((link, T0 + timedelta(microseconds=us), us, seq, is_tx))
        batches.append(batch)
    batches.append([(-1, T0 + timedelta(days=1), 86_400_000_000, -1, True)])
    origin = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    batches = [[(s, ts, us + origin, seq, t) for s, ts, us, seq, t in b] for b in batches]
    stream = _files(spark, f"{tmp_path}/in", batches, "series long, ts timestamp, us long, seq long, is_tx boolean")
    out = state.consuming_feedback(stream, 50, "1 second")
    query = out.writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3 * 5
    got = [(r["series"], r["tx_seq"], r["fb_seq"]) for r in spark.read.parquet(f"{tmp_path}/out").where("tx_seq >= 0").collect()]
    want = []
    for link in [*range(60), None]:
        found = consumed([(us + origin, seq, t) for seq, (s, us, t) in links.items() if s == link], 50_000)
        want += [(link, tx, fb) for tx, fb in found.items()]
    assert sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_late_rows_of_waiting_transmissions():
    """Rows behind the newest one are released, and chosen, as by a look at all of them."""
    pick = random.Random(3)
    for _ in range(200):
        waiting, plain = state._Waiting(()), []
        for seq in range(40):
            us, move = pick.randrange(0, 60_000, 2_500), pick.random()
            if move < 0.5:
                waiting.add(us, seq)
                plain.append((us, seq))
            elif move < 0.7:
                assert waiting.release(us) == [s for u, s in plain if u < us]
                plain = [r for r in plain if r[0] >= us]
            elif plain:
                at = next(i for i, r in enumerate(plain) if r[0] // 10_000 == plain[-1][0] // 10_000)
                assert waiting.take() == plain.pop(at)[1]
        assert list(waiting.rows) == plain
