"""Token ids of documents as Arrow files of equal-length sequences, and reading them back.

One task writes one shard: ``<shard>.arrow`` in the Arrow stream-file format, whose batches hold three
fixed-size lists per sequence (``input_ids``, ``attention_mask``, ``doc_end``), and ``<shard>.docs`` with the
documents of the shard in order. Buffers are not compressed, so a memory-mapped file gives any sequence without a
copy. Files are named by attempt; only those in the manifest that the write returns are part of the output, so a
task that ran twice or died leaves files that nothing reads.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, small_batches
from .pretokens import splitter, worker_pieces

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 64
MANIFEST = "shard int, path string, docs long, tokens long"


def _schema(length: int, ids: np.dtype) -> pa.Schema:
    bits = pa.list_(pa.bool_(), length)
    return pa.schema({"input_ids": pa.list_(pa.from_numpy_dtype(ids), length), "attention_mask": bits, "doc_end": bits})


def _store(path: str):
    """File system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Shard:
    """Packs ids one after the other into sequences and writes them batch by batch."""

    def __init__(self, path: str, length: int, per_batch: int, ids: np.dtype):
        self.store, at = _store(path)
        self.store.create_dir(at.rpartition("/")[0], recursive=True)
        self.length, self.cut, self.schema = length, length * per_batch, _schema(length, ids)
        self.dtype, self.parts, self.ends, self.held, self.tokens = ids, [], [], 0, 0
        self.sink = self.store.open_output_stream(f"{at}.arrow")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.doc_sink = self.store.open_output_stream(f"{at}.docs")
        self.docs = pa.ipc.new_file(self.doc_sink, pa.schema({"doc_id": pa.int64()}))

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.ends.append(self.held - 1)
        if self.held >= self.cut:
            self._flush(self.held // self.cut * self.cut)

    def _flush(self, upto: int) -> None:
        held = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        ends = np.asarray(self.ends, dtype=np.int64)
        for start in range(0, upto, self.cut):
            part = held[start:min(start + self.cut, upto)]
            rows = -(-len(part) // self.length)
            ids = np.zeros(rows * self.length, self.dtype)
            ids[:len(part)] = part
            last = np.zeros(len(ids), bool)
            last[ends[(ends >= start) & (ends < start + len(part))] - start] = True
            flat = [pa.array(ids), pa.array(np.arange(len(ids)) < len(part)), pa.array(last)]
            lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in flat]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.parts, self.held = [held[upto:]], len(held) - upto
        self.ends = (ends[ends >= upto] - upto).tolist()

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        for x in (self.writer, self.sink, self.docs, self.doc_sink):
            x.close()


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, length: int = SEQUENCE,
                      per_batch: int = SEQUENCES_PER_BATCH) -> DataFrame:
    """Write the ids of every text, each with ``end_id`` after it, in ascending ``doc_id``; returns the manifest.

    Rows are range-partitioned, so a shard holds one range of ids and shards are numbered in order. Null texts are
    empty (only the end id); a null id comes first; rows of one id are all written, ordered by text. The last
    sequence of a shard is filled up with masked zeros. Needs the columns ``doc_id`` and ``text``; others are not
    written. An empty table gives an empty manifest. The manifest is stored, so it names the attempts that count.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, shard = splitter(tokenizer), TaskContext.get().partitionId()
        dtype = np.dtype("<u2" if max(cut.size, end_id + 1) <= 1 << 16 else "<u4")
        end = np.array([end_id], dtype).tobytes()
        piece_ids = worker_pieces((tokenizer, "ids"), lambda piece: np.array(cut.ids(piece), dtype).tobytes()).__getitem__
        name, out, n = f"{path.rstrip('/')}/shard-{shard:06d}-{uuid4().hex}", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or _Shard(name, length, per_batch, dtype)
            for text in batch.column(1).to_pylist():
                pieces = cut.cut(text)
                if pieces is None:
                    own = np.array([*cut.ids(text), end_id], dtype)
                else:
                    own = np.frombuffer(b"".join(map(piece_ids, pieces)) + end, dtype)
                out.add(own)
            out.docs.write_batch(pa.record_batch([batch.column(0)], names=["doc_id"]))
            n += batch.num_rows
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [name], "docs": [n], "tokens": [out.tokens]}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(encode, MANIFEST), "token-manifest")


def sequence(path: str, index: int) -> dict[str, np.ndarray]:
    """Sequence ``index`` of a shard: ids without a copy if the file can be mapped, and both masks."""
    store, at = _store(path)
    local = isinstance(store, pafs.LocalFileSystem)
    source = pa.memory_map(f"{at}.arrow") if local else store.open_input_file(f"{at}.arrow")
    reader = pa.ipc.open_file(source)
    per_batch = reader.get_batch(0).num_rows
    row = reader.get_batch(index // per_batch).slice(index % per_batch, 1)
    return {n: row.column(n).flatten().to_numpy(zero_copy_only=n == "input_ids") for n in row.schema.names}


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files in order: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` with the
    end id, and ``ids_crc32`` of the ids as little-endian 32-bit integers. Lengths come from the end marks in the
    files, one batch of sequences in memory at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _digest(name, before)

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard: the window and the repartition move a few numbers only.
    shards = manifest.select("path", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    spread = shards.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(name: str, start: int) -> Iterator[pa.RecordBatch]:
    store, at = _store(name)
    with store.open_input_file(f"{at}.docs") as f:
        documents = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks()
    with store.open_input_file(f"{at}.arrow") as f:
        reader, done, crc, n = pa.ipc.open_file(f), 0, 0, 0
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            ids, mask, ends = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in batch.schema.names)
            ids, last, rows, begin = ids[mask].astype("<u4"), np.flatnonzero(ends[mask]), [], 0
            for stop in (last + 1).tolist():
                part = ids[begin:stop]
                rows.append((start, n + len(part), zlib.crc32(part, crc)))
                start, n, crc, begin = start + n + len(part), 0, 0, stop
            crc, n = zlib.crc32(ids[begin:], crc), n + len(ids) - begin
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))]
            own = documents.slice(done, len(rows))
            done += len(rows)
            yield pa.RecordBatch.from_arrays([own, *columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    if done != len(documents):
        raise ValueError(f"{name}: {done} ends for {len(documents)} documents")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new place in the shared folder and read the files back."""
    path = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, path, end_id))
