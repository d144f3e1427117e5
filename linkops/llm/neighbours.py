"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives every vector a long hash string of ``DEPTH`` symbols; a symbol names the nearest of the signed axes
of a random projection. A tree is the array of its hash strings in sorted order (the stored index is range-partitioned
and sorted by tree and hash), and vectors that share a prefix are a run of it. A query descends to the longest prefix
at which all trees together hold enough rows, ascending symbol by symbol in all trees at once, and the rows of
those runs are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, staged
from .common import materialize, small_batches

TREES, DEPTH, AXES = 160, 8, 16
BITS = int(math.log2(2 * AXES))
# A query ascends until its runs hold n ** POWER different rows, and LEAST at least; more rows mean a better recall and more work.
POWER, LEAST = 0.75, 1_000
# Queries whose vectors a task holds at once; more are searched for block by block.
BLOCK = 20_000
SEED = 20_240_601


def distinct_vectors(rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Stored ``cls, vec, dim, ids``: one row per distinct usable vector with its ``k + 1`` smallest ids.

    No result can need more ids of one vector, so a vector with very many copies is cut on the map side.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    usable = rows.select(F.col(vec_id).cast("long").alias("id"), values.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & (norm > 0)
    )
    first = usable.withColumn("rank", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rank") <= k + 1)
    out = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return materialize(out.select(F.col("ids")[0].alias("cls"), "vec", F.size("vec").alias("dim"), "ids"), "vectors")


def _axes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * DEPTH * AXES), dtype=np.float32)


def hash_strings(vectors: np.ndarray, axes: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings (rows x trees) as integers, first symbol highest."""
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    seen = (unit @ axes).reshape(len(unit), trees, DEPTH, AXES)
    best = np.abs(seen).argmax(axis=3)
    sign = np.take_along_axis(seen, best[..., None], 3)[..., 0] > 0
    out = np.zeros(best.shape[:2], np.int64)
    for d in range(DEPTH):
        out = (out << BITS) | (2 * best[:, :, d] + sign[:, :, d])
    return out


def forest(vectors: DataFrame, trees: int = TREES) -> DataFrame:
    """Stored sorted arrays ``tree, hash, cls`` of all vectors; vectors of another length have trees of their own."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for batch in batches:
            cls, vec = batch.column(0).to_numpy(), batch.column(1)
            dims, flat, offsets = batch.column(2).to_numpy(), vec.values.to_numpy(), vec.offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                axes.setdefault(dim, _axes(dim, trees))
                values = flat[offsets[at][:, None] + np.arange(dim)]
                strings = hash_strings(values, axes[dim], trees)
                tree = np.arange(trees, dtype=np.int64) + dim * trees
                yield pa.RecordBatch.from_pydict({
                    "tree": np.tile(tree, len(at)), "hash": strings.ravel(), "cls": np.repeat(cls[at], trees),
                })

    rows = vectors.select("cls", "vec", "dim").mapInArrow(hashes, "tree long, hash long, cls long")
    return materialize(rows.repartitionByRange("tree", "hash").sortWithinPartitions("tree", "hash"), "forest")


def _prefix(level: int):
    return F.shiftright("hash", BITS * (DEPTH - level))


def _levels(index: DataFrame, own: DataFrame, n: int, queries: int, wanted: float, trees: int) -> np.ndarray:
    """The deepest level of each query at which its runs hold ``wanted`` rows, counted in each tree; level 0 holds all."""

    def rows_at(level: int, active: np.ndarray) -> np.ndarray:
        spark = index.sparkSession
        some = spark.createDataFrame(active.astype(np.int64).reshape(-1, 1).tolist(), "q long")
        runs = own.join(F.broadcast(some), "q").select("q", "tree", _prefix(level).alias("prefix"))
        sizes = index.groupBy("tree", _prefix(level).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        found = runs.join(sizes, ["tree", "prefix"]).groupBy("q").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(queries, np.int64)
        out[found["q"].to_numpy()] = found["n"].to_numpy() - trees  # the query itself is in every tree
        return out[active]

    start = min(DEPTH, max(1, math.ceil(math.log(max(n * trees / wanted, 2), 2 * AXES))))
    levels = np.full(queries, start)
    everything = np.arange(queries)
    enough = rows_at(start, everything) >= wanted
    deeper, higher = everything[enough], everything[~enough]
    for level in range(start + 1, DEPTH + 1):
        if not len(deeper):
            break
        deeper = deeper[rows_at(level, deeper) >= wanted]
        levels[deeper] = level
    for level in range(start - 1, -1, -1):
        if not len(higher):
            break
        levels[higher] = level
        if level:
            higher = higher[rows_at(level, higher) < wanted]
    return levels


def _counts(queries: int):
    """Lists of queries to the number of lists that each is in; a task reports every query once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(queries, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=queries)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"q": some, "n": total[some]})

    return count


def _candidates(index: DataFrame, own: DataFrame, n: int, queries: int, wanted: float, trees: int) -> DataFrame:
    """``cls, qs``: every row of the runs of each query, once. Where the runs of many trees hold the same rows, as in a
    dense cluster, a query goes on ascending until ``wanted`` different rows are there, or all."""
    spark = index.sparkSession
    levels, open_, lists = _levels(index, own, n, queries, wanted, trees), np.arange(queries), None
    while len(open_):
        hits = None
        for level in np.unique(levels[open_]).tolist():
            some = spark.createDataFrame(open_[levels[open_] == level].reshape(-1, 1).tolist(), "q long")
            runs = own.join(F.broadcast(some), "q").select("q", "tree", _prefix(level).alias("prefix"))
            if not level:
                runs = runs.where(F.col("tree") % trees == 0)
            runs = runs.groupBy("tree", "prefix").agg(F.collect_list("q").alias("qs"))
            hit = index.withColumn("prefix", _prefix(level)).join(runs, ["tree", "prefix"]).select("cls", "qs")
            hits = hit if hits is None else hits.unionByName(hit)
        part = hits.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
        part = materialize(part, "candidates")
        lists = part if lists is None else lists.unionByName(part)
        found = part.select("qs").mapInArrow(_counts(queries), "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).toPandas()
        rows = np.zeros(queries, np.int64)
        rows[found["q"].to_numpy()] = found["n"].to_numpy() - 1  # but the query itself
        open_ = open_[(rows[open_] < wanted) & (levels[open_] > 0)]
        levels[open_] -= 1
    return lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))


def _best(q: np.ndarray, cls: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((cls, -score, q))
    q, cls, score = q[order], cls[order], score[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[rank < keep], cls[rank < keep], score[rank < keep]


def _score(candidates: DataFrame, matrix: np.ndarray, dims: np.ndarray, keep: int) -> DataFrame:
    """``cls, vec, qs`` to the best ``keep`` of every query in each task: ``q, cls, score``."""
    shared = candidates.sparkSession.sparkContext.broadcast((matrix, dims))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, lengths = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def shrink():
            return [_best(*(np.concatenate(x) for x in zip(*held)), keep)] if held else []

        for batch in batches:
            cls, vec, qs = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            flat, at = vec.values.to_numpy(), vec.offsets.to_numpy()
            ids, to = qs.values.to_numpy(), qs.offsets.to_numpy()
            for i in range(len(cls)):
                x, q = flat[at[i]:at[i + 1]], ids[to[i]:to[i + 1]]
                q = q[lengths[q] == len(x)]
                own = queries[q, :len(x)]
                cosine = (own @ x) / (np.sqrt((own * own).sum(axis=1)) * math.sqrt(float(x @ x)))
                held.append((q, np.full(len(q), cls[i]), cosine))
                size += len(q)
                if size > 1_000_000:
                    held = shrink()
                    size = len(held[0][0])
        for q, c, s in shrink():
            yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "cls": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    return candidates.select("cls", "vec", "qs").mapInArrow(score, "q long, cls long, score double")


@staged
def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, power: float = POWER) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row of ``queries`` but the row itself.

    ``queries`` are rows of ``rows``. Nearness is the cosine in double precision, ties go to the smaller id. Rows with
    a null id and vectors that are null, empty, zero or hold null or non-finite values take no part; a query is
    compared with vectors of its own length. Fewer than ``k`` other rows: all of them. Copies of a vector are indexed
    once and come back by id. An empty table gives no rows. Other columns are not looked at.
    """
    spark = rows.sparkSession
    small_batches(spark)
    vectors = distinct_vectors(rows, k, vec_id, vector)
    index = forest(vectors, trees)
    n = vectors.count()
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), values.alias("vec"))
    asked = materialize(asked.join(vectors.select("cls", "vec"), "vec").select("query_id", "cls"), "queries")
    wanted = asked.select("cls").distinct()
    blocks = max(1, -(-wanted.count() // BLOCK))
    wanted = materialize(wanted.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(blocks))), "query-vectors")
    found = None
    for block in range(blocks):
        part = vectors.join(small_side(wanted.where(F.col("block") == block).select("cls")), "cls", "left_semi")
        held = part.select("cls", "vec").orderBy("cls").toPandas()  # about BLOCK rows
        if not len(held):
            continue
        dims = np.array([len(v) for v in held["vec"]])
        matrix = np.zeros((len(held), int(dims.max())))
        for i, v in enumerate(held["vec"]):
            matrix[i, :len(v)] = v
        names = spark.createDataFrame(list(enumerate(held["cls"].tolist())), "q long, cls long")
        own = materialize(index.join(F.broadcast(names), "cls").select("q", "tree", "hash"), "query-hashes")
        merged = _candidates(index, own, n, len(held), max(LEAST, n ** power), trees)
        scored = _score(vectors.join(merged, "cls"), matrix, dims, k + 1)
        best = scored.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls")))
        best = best.where(F.col("at") <= k + 1).join(F.broadcast(names.withColumnRenamed("cls", "own")), "q")
        best = materialize(best.select("own", "cls", "score"), "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids = found.join(vectors.select("cls", "ids"), "cls").select("own", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.withColumnRenamed("cls", "own").join(ids, "own").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
