"""Ranked lexical search by presence masks.

Documents are reduced to the terms that some item asks for. A task reads them in blocks; for each item it lays the
terms' bitmaps over each other, so that every document of the block gets a mask of the terms it holds, and groups
the documents by mask. No document of a mask can score more than the sum of its terms' largest scores in the block.
Masks are scored from the largest such bound down, until the next bound is below the lowest score that is still
among the best, so all other groups are left out unseen and nothing is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import batch_rows, materialize, render

TOP = 10
# Items are searched for in blocks of about this many different (item, term) pairs; only a block's terms are broadcast.
BLOCK_PAIRS = 250_000
# Documents of one block of bitmaps, and postings after which a block is closed early.
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 4_000_000
# Rows sent to Python at once: whole texts, and reduced documents.
TEXT_ROWS, ROWS = 256, 4_096

# What is no digit, ASCII letter or byte of a non-ASCII character separates terms; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    return (text or b"").translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Stored ``item, item_id, terms, counts``: different terms and their number of occurrences, one row for each
    distinct id and text that has a term. ``item`` is a number of the row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([list(c) for c in counted], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())),
            ], ["item_id", "terms", "counts"])

    kind = items.select("item_id").schema[0].dataType.simpleString()
    with batch_rows(items.sparkSession, TEXT_ROWS):
        found = items.select("item_id", "text").distinct().mapInArrow(rows, f"item_id {kind}, terms array<binary>, counts array<long>")
        return materialize(found.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")


def reduced(docs: DataFrame, vocabulary) -> DataFrame:
    """Stored ``doc_id, n, terms, tfs``: number of terms of each document, and the numbers and occurrences of those in
    ``vocabulary``, a broadcast map of terms to numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            n, flat, tfs, at = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = terms(text)
                held = Counter(map(number, own))
                held.pop(None, None)
                n.append(len(own))
                flat.extend(held)
                tfs.extend(held.values())
                at.append(len(flat))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64())),
            ], ["doc_id", "n", "terms", "tfs"])

    with batch_rows(docs.sparkSession, TEXT_ROWS):
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return materialize(out.mapInArrow(rows, "doc_id long, n long, terms array<int>, tfs array<long>"), "reduced")


def weight(total: int, df: int) -> int:
    """Weight of a term that ``df`` of ``total`` documents hold."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def length_factors(n: np.ndarray, total: int, length: int) -> np.ndarray:
    """100 - 75 + 75 n N div L for each document, in exact integers."""
    if 75 * total * int(n.max(initial=0)) >= 1 << 63:
        return np.array([25 + 75 * v * total // length for v in n.tolist()], np.int64)
    return 25 + 75 * n * total // length


class _Best:
    """The ``top`` best scores of an item so far; equal scores by number of the document, null last."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.null = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def floor(self) -> int:
        """Lowest score that can still get in."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores, ids, null) -> None:
        good = scores >= self.floor()
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.ids, ids[good]), (self.null, null[good])))
        first = np.lexsort((ids, null, -scores))[:self.top]
        self.scores, self.ids, self.null = scores[first], ids[first], null[first]


class _Block:
    """Documents of one block: postings by document and by term, with their scores per occurrence in an item."""

    def __init__(self, ids, null, at, postings, impact):
        self.ids, self.null, self.at, self.postings, self.impact = ids, null, at, postings, impact
        order = np.argsort(postings, kind="stable")
        self.docs = np.repeat(np.arange(len(ids)), np.diff(at))[order]
        self.present, first = np.unique(postings[order], return_index=True)
        self.first = np.append(first, len(order))
        self.most = np.maximum.reduceat(impact[order], first) if len(order) else np.empty(0, np.int64)

    def masks(self, asked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with any of the asked terms ordered by the bound of their mask, where each mask's group ends, and
        the bounds of the groups, largest first."""
        where = np.searchsorted(self.present, asked)
        held = np.nonzero((where < len(self.present)) & (np.take(self.present, where, mode="clip") == asked))[0] if len(self.present) else []
        rows = np.zeros((max(8, -(-len(held) // 8)), len(self.ids)), np.uint8)
        bound = np.zeros(rows.shape[0] * 8, np.int64)
        for bit, j in enumerate(held):
            at = where[j]
            rows[bit >> 3][self.docs[self.first[at]:self.first[at + 1]]] |= np.uint8(1 << (bit & 7))
            bound[bit] = self.most[at] * counts[j]
        docs = np.nonzero(rows.any(axis=0))[0]
        packed = np.ascontiguousarray(rows[:, docs].T)
        key = packed.view(np.uint64).ravel() if rows.shape[0] == 8 else packed.view(np.dtype((np.void, rows.shape[0]))).ravel()
        _, one, back, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        bounds = np.zeros(len(one), np.int64)
        for byte in range(-(-len(held) // 8)):
            table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64) @ bound[8 * byte:8 * byte + 8]
            bounds += table[packed[one, byte]]
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return docs[np.argsort(rank[back.ravel()], kind="stable")], np.cumsum(size[order]), bounds[order]

    def scores(self, docs: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Scores of documents with at least one posting; ``count`` is the item's number of each term."""
        length = self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(length)
        places = np.repeat(self.at[docs] - ends + length, length) + np.arange(ends[-1])
        return np.add.reduceat(self.impact[places] * count[self.postings[places]], ends - length)


def search_block(block: _Block, asked: np.ndarray, counts: np.ndarray, count: np.ndarray, best: _Best) -> int:
    """Add the block's documents that can be among the best of an item; the number of documents that were scored."""
    docs, ends, bounds = block.masks(asked, counts)
    done, group, step = 0, 0, 64
    while group < len(ends) and bounds[group] >= best.floor():
        last = int(np.searchsorted(ends, done + step))
        inside = int(np.searchsorted(-bounds, -best.floor(), side="right"))  # groups whose bound reaches the floor
        group = min(last + 1, inside, len(ends))
        part = docs[done:ends[group - 1]]
        best.add(block.scores(part, count), block.ids[part], block.null[part])
        done, step = int(ends[group - 1]), step * 2
    return done


def _search_block_of_items(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """Stored ``item, doc_id, score``: the best of each task for each item of one block."""
    spark = docs.sparkSession
    asked = [(r["item"], r["terms"], r["counts"]) for r in items.select("item", "terms", "counts").collect()]
    vocabulary: dict[bytes, int] = {}
    coded = [(i, np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in ts], np.int64), np.array(c, np.int64)) for i, ts, c in asked]
    shared = spark.sparkContext.broadcast(vocabulary)
    index = reduced(docs, shared)
    size = index.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    total, length = size["n"], size["l"]
    # At most one row for each term of the block.
    df = {r[0]: r[1] for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(total, df[t]) if t in df else 0 for t in range(len(vocabulary))], np.int64)
    plan = spark.sparkContext.broadcast((coded, weights))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, weights = plan.value
        best = [_Best(top) for _ in coded]
        count = np.zeros(len(weights), np.int64)

        def close(held: list) -> None:
            ids, null, n, size, postings, tfs = (np.concatenate(x) for x in zip(*held))
            at = np.concatenate(([0], np.cumsum(size)))
            factor = np.repeat(length_factors(n, total, length), size)
            block = _Block(ids, null, at, postings, weights[postings] * (1_000_000_000 * tfs // (1000 * tfs + 8 * factor)))
            for (_, asked, counts), own in zip(coded, best):
                count[asked] = counts
                search_block(block, asked, counts, count, own)
                count[asked] = 0

        held, docs_held, postings_held = [], 0, 0
        for batch in batches:
            ids, n, lists, tfs = (batch.column(k) for k in range(4))
            held.append((
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), n.to_numpy(),
                np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(),
            ))
            docs_held += batch.num_rows
            postings_held += len(held[-1][4])
            if docs_held >= BLOCK_DOCS or postings_held >= BLOCK_POSTINGS:
                close(held)
                held, docs_held, postings_held = [], 0, 0
        if docs_held:
            close(held)
        for (item, _, _), own in zip(coded, best):
            if len(own.scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own.scores), item)), pa.array(own.ids, mask=own.null), pa.array(own.scores),
                ], ["item", "doc_id", "score"])

    with batch_rows(spark, ROWS):
        return materialize(index.where(F.size("terms") > 0).mapInArrow(rows, "item long, doc_id long, score long"), "best")


@staged
def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Stored ``item_id, rank, doc_id, score``: the ``top`` best documents of each item, scores above 0 only.

    Every row of ``docs`` (``doc_id``, ``text``) is a document, repeated rows and null ids included, and counts in the
    statistics. Equal scores are ranked by ascending id, null last. Items (``item_id``, ``text``) that are equal in both
    are one item; an item without terms, and any item where no document has its terms, gives no row. Null texts have
    no terms. Other columns are not looked at.
    """
    asked = item_terms(items)
    pairs = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-pairs // block_pairs))
    best = None
    for block in range(blocks):
        found = _search_block_of_items(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), top)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def sql(top: int = TOP) -> str:
    """The search of ``documents`` for ``benchmark`` in DuckDB's SQL."""
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return render(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS total, CAST(sum(len(w)) AS BIGINT) AS length FROM d),
b AS (SELECT row_number() OVER () AS b, item_id, {cut} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT b, item_id, term, count(*) AS c FROM (SELECT b, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * max(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY 1),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * total) // length AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT b, item_id, r, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0) WHERE rank <= {top}""", cut=cut, top=top)
