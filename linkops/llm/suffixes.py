"""Exact repeated substrings by minimiser grouping, in place of distributed prefix doubling.

Prefix doubling ranks all positions by their first bytes, sorts pairs (rank here, rank half a length further on), and
ranks again, until a position is unique or the length is past the threshold. Every position in every round would move
many times the text (by estimate; no doubling run was measured). There are no rounds at growing lengths here, but three
fixed steps that name what they can by position classes:

1. Half the threshold. A string of ``length`` bytes has ``half + 1`` strings of half that length; the smallest of their
   fingerprints is its rank. Neighbouring strings mostly have the same smallest one, so a document falls into *runs*
   of starts with one rank. Spark sorts runs by rank; a run whose rank no other run has is unique and done.
2. The whole run. Runs of one rank are ranked again by all bytes under the run: equal ones repeat as they are, start
   for start.
3. The threshold. For ranks with several different runs, and for runs that may repeat within themselves, every start
   of one run of each kind is ranked by the pair of its two halves, and equal pairs repeat.

Fingerprints are 64-bit; two strings count as equal when their run's rank and their own fingerprint agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, staged
from .common import batch_rows, fresh, materialize, small_batches
from .pretokens import forget

LENGTH = 200
BLOCK = 1 << 20
# Bytes under the runs of one rank that are resolved in one task; ranks with more go through a shuffle by the names of
# their starts.
GROUP_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20
# Runs with their bytes that are sent to Python at once; a run has at most a block.
RUN_ROWS = 64

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` (kept per worker)."""
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, BLOCK + 1024), base & _MASK, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash, and the factors that move a difference to its place."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], dtype=np.uint64, out=sums[1:])
    return sums, down


def _sliding(x: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Smallest (``low``) or largest value of every ``width`` neighbours."""
    op, pad = (np.minimum, _MASK) if low else (np.maximum, 0)
    n = len(x) - width + 1
    y = np.full(-(-len(x) // width) * width, pad, np.uint64)
    y[:len(x)] = x
    y = y.reshape(-1, width)
    left = op.accumulate(y, axis=1).ravel()
    right = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[width - 1:width - 1 + n])


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rank, fingerprint of all bytes, first start, number of starts and a mark for possible repeats within, per run."""
    half = length // 2
    sums, down = _sums(data)
    width = length - half + 1
    grams = _mix((sums[half:] - sums[:-half]) * down[:len(data) - half + 1])
    least = _sliding(grams, width, True)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    stop = np.r_[start[1:], len(least)]
    whole = _mix((sums[stop - 1 + length] - sums[start]) * down[start]) ^ _mix((stop - start).astype(np.uint64))
    # A gram is some window's smallest if it equals the largest minimum of the windows that hold it. More such grams
    # than runs: a run has two equal ones, so it may hold two equal strings.
    top = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, False)
    again = np.zeros(len(start), bool)
    chosen = grams[top == grams]
    if len(chosen) > len(start):
        values, n = np.unique(chosen, return_counts=True)
        again = np.isin(least[start], values[n > 1])
    return least[start], whole, start, stop - start, again


def _pack(first: np.ndarray, count: np.ndarray, again: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 22) | (count.astype(np.int64) << 1) | again


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """``rank, whole, key, at`` of all runs of ``key, bytes``; ``at`` packs first start, number of starts and mark."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            parts = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(value.as_buffer(), np.uint8)
                for begin in range(0, len(data) - length + 1, BLOCK):
                    rank, whole, first, count, again = runs_of(data[begin:begin + BLOCK + length - 1], length)
                    parts.append((rank.view(np.int64), whole.view(np.int64), np.full(len(rank), key), _pack(first + begin, count, again)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["rank", "whole", "key", "at"])

    return texts.mapInArrow(rows, "rank long, whole long, key long, at long")


def _starts(ranks: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, run and place in its run of every start of the given runs."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sums, down = _sums(data)
    sizes = np.array([len(c) for c in contexts])
    counts, begin = sizes - length + 1, np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(contexts)), counts)
    place = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, half = begin[run] + place, length // 2
    first, second = ((sums[at + o + half] - sums[at + o]) * down[at + o] for o in (0, length - half))
    return _mix(_mix(first) ^ _mix(second + np.uint64(_BASE)) ^ _mix(ranks.view(np.uint64)[run])), run, place


def _spans(run: np.ndarray, place: np.ndarray, key: np.ndarray, first: np.ndarray, length: int) -> pa.RecordBatch:
    """Byte spans of starts that repeat, neighbouring starts together."""
    new = np.r_[True, (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)] if len(run) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(run)] - 1 if len(begin) else begin
    return pa.RecordBatch.from_pydict({
        "key": key[run[begin]], "start": first[run[begin]] + place[begin], "stop": first[run[end]] + place[end] + length,
    })


SPANS = "key long, start long, stop long"


def _resolve(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the starts that repeat among the runs of each rank; rows come sorted by rank, whole ranks at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rank, key, at, data = (list(x) for x in zip(*rows))
        name, run, place = _starts(np.array(rank, np.int64), data, length)
        _, back, n = np.unique(name, return_inverse=True, return_counts=True)
        wanted = np.array([k is not None for k in key])
        hit = (n[back] > 1) & wanted[run]
        keys = np.array([0 if k is None else k for k in key], np.int64)
        return _spans(run[hit], place[hit], keys, np.array(at, np.int64) >> 22, length)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and row[0] != held[-1][0] and size > CHUNK_BYTES:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    ordered = contexts.repartition("rank").sortWithinPartitions("rank")
    return ordered.select("rank", "key", "at", "data").mapInArrow(spans, SPANS)


def _progressions(name: np.ndarray, run: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of equal names in a run as evenly spaced rows: index of the first, step and number of each."""
    order = np.lexsort((place, name, run))
    name, run, place = name[order], run[order], place[order]
    same = np.r_[False, (run[1:] == run[:-1]) & (name[1:] == name[:-1])]
    step = np.where(same, np.r_[0, np.diff(place)], 0)
    new = np.flatnonzero(~same | (np.r_[False, same[:-1]] & (step != np.r_[0, step[:-1]])))
    n = np.diff(np.r_[new, len(name)])
    return order[new], np.where(n > 1, step[np.minimum(new + 1, len(step) - 1)], 0), n


def _resolve_apart(contexts: DataFrame, length: int) -> DataFrame:
    """The same for ranks with very many bytes, dealt by the names of their starts. Evenly spaced starts of one name are
    one row, so a periodic run takes as many rows as its period has places, however long it is."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, begin = batch.column(2).to_numpy() >> 22, 0, 0
            data = batch.column(3).to_pylist()
            for end in range(1, batch.num_rows + 1):
                size += len(data[end - 1])
                if end < batch.num_rows and size < CHUNK_BYTES:
                    continue
                name, run, place = _starts(batch.column(0).to_numpy()[begin:end], data[begin:end], length)
                at, step, n = _progressions(name, run, place)
                yield pa.RecordBatch.from_arrays([
                    pa.array(name[at].view(np.int64)), batch.column(1).take(pa.array(run[at] + begin)),
                    pa.array(first[begin + run[at]] + place[at]), pa.array(step.astype(np.int64)), pa.array(n.astype(np.int64)),
                ], names=["name", "key", "start", "step", "n"])
                begin, size = end, 0

    rows = contexts.select("rank", "key", "at", "data").mapInArrow(names, "name long, key long, start long, step long, n long")
    many = rows.withColumn("all", F.sum("n").over(Window.partitionBy("name"))).where((F.col("all") > 1) & F.col("key").isNotNull())
    # Strings no farther apart than their length cover everything from the first to the last.
    last = F.col("start") + (F.col("n") - 1) * F.col("step")
    dense = F.array(F.struct(F.col("start"), (last + length).alias("stop")))
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.col("start") + i * F.col("step"))
    apart = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + length).alias("stop")))
    spans = F.when(F.col("step") <= length, dense).otherwise(apart)
    return many.select("key", F.explode(spans).alias("span")).select("key", "span.start", "span.stop")


@staged
def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Stored byte ``spans`` (start, stop; sorted) of each ``key`` of ``key, bytes`` covered by strings of ``length`` bytes
    that start anywhere else too. Equal texts of one key count as each other's repeats."""
    ranked = Window.partitionBy("rank")
    same = Window.partitionBy("rank", "whole")
    first = F.row_number().over(same.orderBy("key", "at")) == 1
    runs = _runs(texts, length).repartition("rank").withColumns({"head": first, "equal": F.count(F.lit(1)).over(same)})
    under = F.shiftright("at", 1).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(length - 1)
    runs = runs.withColumns({"kinds": F.sum(F.col("head").cast("int")).over(ranked), "size": F.sum(F.when(F.col("head"), under)).over(ranked)})
    again = F.col("at").bitwiseAND(F.lit(1)) == 1
    runs = runs.where((F.col("equal") > 1) | (F.col("kinds") > 1) | again)
    runs = materialize(runs.select("rank", "key", "at", "head", (F.col("equal") > 1).alias("twice"), "kinds", "size"), "runs")
    start, count = F.shiftright("at", 22), F.shiftright("at", 1).bitwiseAND(F.lit((1 << 21) - 1))
    plain = runs.where("twice").select("key", start.alias("start"), (start + count + F.lit(length - 1)).alias("stop"))
    # One run of each kind shows its bytes; a kind that repeats as a whole needs no spans of its own.
    asked = runs.where(F.col("head") & ((F.col("kinds") > 1) | (again & ~F.col("twice"))))
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("rank", "at", "twice", "size")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, key, at, size, data = [], [], [], [], []
            for k, raw, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = memoryview(raw.as_buffer())
                for r in runs:
                    begin, n = r["at"] >> 22, (r["at"] >> 1) & ((1 << 21) - 1)
                    rank.append(r["rank"])
                    key.append(None if r["twice"] else k)
                    at.append(r["at"])
                    size.append(r["size"])
                    data.append(bytes(raw[begin:begin + n + length - 1]))
            yield pa.RecordBatch.from_pydict({
                "rank": pa.array(rank, pa.int64()), "key": pa.array(key, pa.int64()), "at": pa.array(at, pa.int64()),
                "size": pa.array(size, pa.int64()), "data": pa.array(data, pa.binary()),
            })

    shown = texts.join(asked, "key").select("key", "bytes", "runs").mapInArrow(
        cut, "rank long, key long, at long, size long, data binary"
    )
    shown = materialize(shown, "run-bytes")
    few = F.col("size") <= GROUP_BYTES
    with batch_rows(texts.sparkSession, RUN_ROWS):
        spans = plain.unionByName(_resolve(shown.where(few), length)).unionByName(_resolve_apart(shown.where(~few), length))
        return materialize(spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Maximal spans of sorted ``start, stop`` pairs; touching ones join."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [tuple(x) for x in out]


@staged
def remove_repeats(docs: DataFrame, length: int = LENGTH, digest_only: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the remaining UTF-8 bytes).

    A byte goes if a string of ``length`` bytes that starts anywhere else too, in this or another document, covers it;
    strings do not cross documents, and what counts is the input. Texts that occur in several rows repeat as a whole,
    so one of them is looked at. Null texts are empty. Ids play no part: rows with null or repeated ids are documents
    like others. Columns named like the outputs are replaced; an empty table stays empty. With ``digest_only``
    neither ``kept`` nor the text is returned.
    """
    small_batches(docs.sparkSession)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    base = docs.drop(*names)
    key, raw, rows, spans, out, span_key, row_key = fresh(base, "_text", "_bytes", "_rows", "_spans", "_out", "_span_key", "_row_key")
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = base.withColumn(key, F.xxhash64(text, F.octet_length(text)))
    counts = materialize(keyed.groupBy(key).agg(F.count(F.lit(1)).alias(rows)).where(F.col(rows) > 1), "equal-texts")
    long_ = keyed.where(F.octet_length(text) >= length).select(F.col(key).alias("key"), text.alias("bytes"))
    copies = small_side(counts.select(F.col(key).alias("key")))
    single = long_.join(copies, "key", "left_anti")
    several = long_.join(copies, "key", "left_semi").dropDuplicates(["key"])
    found = repeated_spans(single.unionByName(several), length)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def removed(texts, spans_, rows_):
        import pandas as pd

        made = []
        for data, own, n in zip(texts, spans_, rows_):
            data = bytes(data)
            cut = [(0, len(data))] if n > 1 and len(data) >= length else merged([] if own is None else own)
            at, parts = 0, []
            for begin, end in cut:
                parts.append(data[at:begin])
                at = end
            kept = b"".join(parts) + data[at:]
            made.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), None if digest_only else kept))
        return pd.DataFrame(made, columns=names)

    own = found.select(F.col("key").alias(span_key), F.col("spans").alias(spans))
    more = small_side(counts.select(F.col(key).alias(row_key), rows))
    joined = keyed.withColumn(raw, text).join(more, F.col(key) == F.col(row_key), "left")
    joined = joined.join(own, F.col(key) == F.col(span_key), "left")
    done = joined.withColumn(out, removed(F.col(raw), F.col(spans), F.coalesce(F.col(rows), F.lit(1))))
    left = [c for c in base.columns if not (digest_only and c == "text")]
    return done.select(*left, *[F.col(f"{out}.{n}").alias(n) for n in names if not (digest_only and n == "kept")])
