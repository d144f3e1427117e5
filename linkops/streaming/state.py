"""Per-link state on the stream: rolling error rate, offset loop, allocator, consuming feedback.

Needs the RocksDB state store provider. State ends: with ``idle``, a link that has sent nothing for so long, by the
watermark, leaves the store, and starts anew if it comes back.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.radio import MCS_MAX
from ..operators.ordered import segments
from ..operators.replay import ALLOCATOR_MAX, allocator_machine

# Block results of one page of the ring behind a rolling rate.
PAGE = 1_024
# Keys that links without an idle time are packed into.
BUCKETS = 512


class _Link(StatefulProcessor):
    """State of one link with an idle timer: ``idle_ms`` after the link's last row it is forgotten (None: never)."""

    columns: tuple[str, ...] = ()
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def advance(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        """Result rows of the new rows of a link, which are in order."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        if self.idle_ms is not None:
            end = int(frame["at_ms"].max()) + self.idle_ms
            set_ = list(self.handle.listTimers())
            if not set_ or max(set_) < end:
                for timer in set_:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(end)
        yield self.advance(key, frame)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        yield self.nothing()

    def nothing(self) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(dtype="Int64") for c in self.columns})

    def close(self) -> None:
        pass


class _RollingError(_Link):
    """Rate over the last W block results per key, from a running sum.

    The results stand in a ring of pages of bits. New rows add to the sum what they bring and take off what they push
    out of the window, so a batch touches the pages at the two ends of the window only, however wide it is.
    """

    columns = ("series", "seq", "bler")

    def __init__(self, width: int, idle_ms: int | None = None):
        self.width, self.idle_ms = width, idle_ms
        self.slots = (-(-width // PAGE) + 1) * PAGE

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "seen long, errors long")
        self.pages = handle.getMapState("pages", "page int", "bits binary")

    def _page(self, page: int) -> np.ndarray:
        if not self.pages.containsKey((page,)):
            return np.zeros(PAGE, np.uint8)
        return np.unpackbits(np.frombuffer(bytes(self.pages.getValue((page,))[0]), np.uint8))

    def _read(self, first: int, n: int) -> np.ndarray:
        """Bits of ``n`` results from the result numbered ``first`` on."""
        if n <= 0:
            return np.zeros(0, np.uint8)
        start = first // PAGE
        held = [self._page(p % (self.slots // PAGE)) for p in range(start, (first + n - 1) // PAGE + 1)]
        return np.concatenate(held)[first - start * PAGE:][:n]

    def _write(self, first: int, bits: np.ndarray) -> None:
        for page in range(first // PAGE, (first + len(bits) - 1) // PAGE + 1):
            slot, begin = page % (self.slots // PAGE), page * PAGE
            held = self._page(slot)
            low, high = max(first, begin), min(first + len(bits), begin + PAGE)
            held[low - begin:high - begin] = bits[low - first:high - first]
            self.pages.updateValue((slot,), (np.packbits(held).tobytes(),))

    def advance(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        new, width = frame["error"].to_numpy().astype(np.int64), self.width
        seen, total = (int(v) for v in self.sums.get()) if self.sums.exists() else (0, 0)
        gone = np.zeros(len(new), np.int64)
        first, last = max(0, width - seen), min(len(new), width)  # from there on rows push out, first old and then new ones
        if first < last:
            gone[first:last] = self._read(seen + first - width, last - first)
        gone[width:] = new[:max(0, len(new) - width)]
        sums = total + np.concatenate(([0], np.cumsum(new - gone)))
        count = np.minimum(seen + np.arange(len(new)), width)
        kept = min(len(new), width)
        self._write(seen + len(new) - kept, new[len(new) - kept:].astype(np.uint8))
        self.sums.update((seen + len(new), int(sums[-1])))
        rate = pd.Series(np.where(count > 0, sums[:-1] / np.maximum(count, 1), np.nan)).astype(object)
        return pd.DataFrame({"series": key[0], "seq": frame["seq"].to_numpy(), "bler": rate.where(rate.notna(), None)})

    def forget(self) -> None:
        self.sums.clear()
        self.pages.clear()


def _offsets(cqi, mask, n: int, failures: int, step: float, target: float, initial: float) -> tuple[list[int], tuple[int, int]]:
    """MCS of the next rows of a link, and its counts of rows and failures after them."""
    out, up = [], step * target
    for report, bits in zip(cqi.tolist(), mask.tolist()):
        mcs = min(max(round(float(report) + (initial + up * n - step * failures)), 0), MCS_MAX)
        failures += 1 - ((int(bits) >> mcs) & 1)
        n += 1
        out.append(mcs)
    return out, (n, failures)


class _OffsetLoop(_Link):
    """Row count and failures so far; together they fix the offset."""

    columns = ("series", "seq", "mcs")

    def __init__(self, step: float, target: float, initial: float, idle_ms: int | None = None):
        self.step, self.target, self.initial, self.idle_ms = step, target, initial, idle_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "rows long, failures long")

    def advance(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        n, failures = self.counts.get() if self.counts.exists() else (0, 0)
        out, counts = _offsets(frame["cqi"].to_numpy(), frame["mask"].to_numpy(), n, failures, self.step, self.target, self.initial)
        self.counts.update(counts)
        return pd.DataFrame({"series": key[0], "seq": frame["seq"].to_numpy(), "mcs": out})

    def forget(self) -> None:
        self.counts.clear()


class _Allocator(_Link):
    """The index given last."""

    columns = ("series", "seq", "alloc_cqi")

    def __init__(self, machine, initial: int, idle_ms: int | None = None):
        self.machine, self.initial, self.idle_ms = machine, initial, idle_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "value int")

    def advance(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        state = self.index.get()[0] if self.index.exists() else self.initial
        values = self.machine.replay([frame["cqi"].to_numpy(), frame["bler"].to_numpy()], 0, int(state))
        self.index.update((min(int(values[-1]), ALLOCATOR_MAX),))
        return pd.DataFrame({"series": key[0], "seq": frame["seq"].to_numpy(), "alloc_cqi": values})

    def forget(self) -> None:
        self.index.clear()


class _Waiting:
    """Transmissions of a link that wait for feedback, in the order in which they came."""

    def __init__(self, rows):
        self.rows = deque(rows)
        self.ordered = all(a[0] <= b[0] for a, b in pairwise(self.rows))

    def add(self, us: int, seq: int) -> None:
        self.ordered = self.ordered and (not self.rows or self.rows[-1][0] <= us)
        self.rows.append((us, seq))

    def release(self, before_us: int) -> list[int]:
        """Takes out those sent before a time; only rows that came late are not at the front."""
        gone = []
        if self.ordered:
            while self.rows and self.rows[0][0] < before_us:
                gone.append(self.rows.popleft()[1])
        else:
            gone = [seq for us, seq in self.rows if us < before_us]
            self.__init__(r for r in self.rows if r[0] >= before_us)
        return gone

    def take(self) -> int:
        """Takes out the first one of the newest 10 ms."""
        newest = self.rows[-1][0] // 10_000
        if self.ordered:
            at = len(self.rows) - 1
            while at and self.rows[at - 1][0] // 10_000 == newest:
                at -= 1
        else:
            at = next(i for i, r in enumerate(self.rows) if r[0] // 10_000 == newest)
        seq = self.rows[at][1]
        del self.rows[at]
        return seq


class _Consume(StatefulProcessor):
    """Pending transmissions of the links of a bucket, in one value; a timer releases those whose window has passed."""

    def __init__(self, window_ms: int):
        self.window = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "links binary")

    def _load(self) -> dict:
        held = self.pending.get()
        return pickle.loads(bytes(held[0])) if held else {}

    def _save(self, links: dict) -> None:
        links = {link: kept for link, kept in links.items() if kept}
        if links:
            self.pending.update((pickle.dumps(links),))
        else:
            self.pending.clear()

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["series", "tx_seq", "fb_seq"]).astype("Int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["unnamed", "series", "us", "seq"], ignore_index=True)
        links, out, width, latest = self._load(), [], self.window * 1000, None
        unnamed, series = frame["unnamed"].tolist(), frame["series"].tolist()
        us, seq, is_tx = (frame[c].tolist() for c in ("us", "seq", "is_tx"))
        for begin, end in segments(frame, ["unnamed", "series"]):
            link = None if unnamed[begin] else series[begin]
            waiting = _Waiting(links.get(link, ()))
            for i in range(begin, end):
                out += [(link, gone, None) for gone in waiting.release(int(us[i]) - width)]
                if is_tx[i]:
                    waiting.add(int(us[i]), int(seq[i]))
                elif waiting.rows:
                    out.append((link, waiting.take(), int(seq[i])))
            links[link] = list(waiting.rows)
            if waiting.rows:
                latest = max(latest or 0, waiting.rows[-1][0] // 1000 + self.window + 1)
        self._save(links)
        if latest is not None:
            self.handle.registerTimer(latest)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit, links, out = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.window * 1000, self._load(), []
        for link, kept in links.items():
            waiting = _Waiting(kept)
            out += [(link, gone, None) for gone in waiting.release(limit)]
            links[link] = list(waiting.rows)
        self._save(links)
        yield self._frame(out)

    def close(self) -> None:
        pass


class _Packed(StatefulProcessor):
    """Links that are never forgotten, many to a key: their states lie in one value, read and written once a batch.

    A call, its state and its output cost some 10 ms a link when each link is a key of its own. ``step`` makes the
    output of a link's rows and its new state from its rows in order and its state (None: a new link).
    """

    def __init__(self, columns: tuple[str, ...], inputs: tuple[str, ...], step):
        self.columns, self.inputs, self.step = columns, inputs, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.links = handle.getValueState("links", "states binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["unnamed", "series", "seq"], ignore_index=True)
        held = self.links.get()
        states = pickle.loads(bytes(held[0])) if held else {}
        inputs, out = [frame[c].to_numpy() for c in self.inputs], []
        unnamed, series = frame["unnamed"].to_numpy(), frame["series"].to_numpy()
        for begin, end in segments(frame, ["unnamed", "series"]):
            link = None if unnamed[begin] else int(series[begin])
            values, states[link] = self.step([c[begin:end] for c in inputs], states.get(link))
            out.append(values)
        self.links.update((pickle.dumps(states),))
        named = pd.Series(series, dtype="Int64").mask(unnamed)
        yield pd.DataFrame(dict(zip(self.columns, (named, frame["seq"].to_numpy(), np.concatenate(out)))))

    def close(self) -> None:
        pass


def _bucketed(df: DataFrame, *columns: str) -> DataFrame:
    link = F.coalesce(F.col("series").cast("long"), F.lit(0))  # pandas has no null among whole numbers
    return df.select(F.pmod(F.xxhash64("series"), F.lit(BUCKETS)).alias("bucket"), F.col("series").isNull().alias("unnamed"),
                     link.alias("series"), *columns)


def _packed(df: DataFrame, step, inputs: tuple[str, ...], columns: tuple[str, ...], schema: str) -> DataFrame:
    rows = _bucketed(df, "seq", *inputs)
    return rows.groupBy("bucket").transformWithStateInPandas(_Packed(columns, inputs, step), schema, "Append", "None")


def _stateful(df: DataFrame, columns, processor: _Link, schema: str, delay: str | None) -> DataFrame:
    """Rows of every link through ``processor``. With an idle timer the frame needs an event time ``ts``, whose
    watermark lags by ``delay``."""
    if processor.idle_ms is None:
        return df.select(*columns).groupBy("series").transformWithStateInPandas(processor, schema, "Append", "None")
    rows = df.withWatermark("ts", delay or "0 seconds").select(*columns, "ts", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("series").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rolling_error_rate(df: DataFrame, width: int, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """``series, seq, error`` to the error rate of the last ``width`` rows before each row."""
    schema = "series long, seq long, bler double"
    if idle_ms is not None or width > PAGE:
        return _stateful(df, ["series", "seq", "error"], _RollingError(width, idle_ms), schema, delay)

    def step(inputs, state):
        last = np.zeros(0, np.int64) if state is None else np.frombuffer(state, np.uint8).astype(np.int64)
        bits = np.concatenate((last, inputs[0].astype(np.int64)))
        at, sums = np.arange(len(last), len(bits)), np.concatenate(([0], np.cumsum(bits)))
        count = np.minimum(at, width)
        rate = pd.Series(np.where(count > 0, (sums[at] - sums[at - count]) / np.maximum(count, 1), np.nan)).astype(object)
        return rate.where(rate.notna(), None).to_numpy(), bits[max(0, len(bits) - width):].astype(np.uint8).tobytes()

    return _packed(df, step, ("error",), _RollingError.columns, schema)


def offset_loop(df: DataFrame, step: float = 0.25, target: float = 0.1, initial: float = 0.0,
                idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """``series, seq, cqi, mask`` to the MCS of the offset loop."""
    schema = "series long, seq long, mcs int"
    if idle_ms is not None:
        return _stateful(df, ["series", "seq", "cqi", "mask"], _OffsetLoop(step, target, initial, idle_ms), schema, delay)

    def advance(inputs, state):
        values, counts = _offsets(*inputs, *(state or (0, 0)), step, target, initial)
        return np.array(values, np.int32), counts

    return _packed(df, advance, ("cqi", "mask"), _OffsetLoop.columns, schema)


def allocator(df: DataFrame, target: float, initial: int = 1, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """``series, seq, cqi, bler`` to the allocated CQI index."""
    schema, machine = "series long, seq long, alloc_cqi int", allocator_machine(target, initial)
    if idle_ms is not None:
        return _stateful(df, ["series", "seq", "cqi", "bler"], _Allocator(machine, initial, idle_ms), schema, delay)

    def step(inputs, state):
        values = machine.replay(inputs, 0, initial if state is None else state)
        return values, min(int(values[-1]), ALLOCATOR_MAX)

    return _packed(df, step, ("cqi", "bler"), _Allocator.columns, schema)


def consuming_feedback(df: DataFrame, window_ms: int = 50, delay: str = "1 second") -> DataFrame:
    """``series, ts, us, seq, is_tx`` to matches; unmatched transmissions leave with a null feedback.

    What waits for feedback is dropped by a timer when its window has passed, so no link stays in the store. Links share
    ``BUCKETS`` keys.
    """
    marked = _bucketed(df.withWatermark("ts", delay), "ts", "us", "seq", "is_tx")
    return marked.groupBy("bucket").transformWithStateInPandas(
        _Consume(window_ms), "series long, tx_seq long, fb_seq long", "Append", "EventTime"
    )
