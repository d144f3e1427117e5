"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import chunked, row_numbers
from ..session import small_side, staged
from .common import fresh, materialize

CAP = 3.0
CHUNK_DOCS = 512
TOLERANCE, MAX_STEPS = 1e-6, 60
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def cyclic_weight(rank: Column) -> Column:
    """Weights 1, 2, 3 and so on again, by the zero-based rank of a source."""
    return F.pmod(rank, F.lit(3)) + F.lit(1)


def source_targets(sizes: DataFrame, weight=cyclic_weight, cap: float = CAP) -> DataFrame:
    """``source, size`` rows to one stored row per source with ``source_size`` and ``target``.

    Targets share the whole by weight; a target stops at ``cap`` times its source, and the rest share what is left
    over by weight, until none is above. That is ``least(cap * size, weight * level)`` for one level, found by one
    aggregate a round; the capped set only grows. Sources count in code point order, null last.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
        F.sum((F.col("size") > 0).cast("long")).alias("filled"),
    )
    ranked = row_numbers(chunked(totals, [], [F.col("source").asc_nulls_last()]), "rank").drop("_chunk", "_idx")
    sources = materialize(ranked.withColumn("weight", weight(F.col("rank")).cast("double")), "sources")
    most, level, capped = F.lit(cap) * F.col("source_size"), 0.0, -1
    while True:
        held = most <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(held, most)).alias("fixed"),
            F.sum(F.when(~held, F.col("weight"))).alias("free"), F.sum(held.cast("long")).alias("n"),
        ).first()
        if not row["all"] or not row["free"] or row["n"] == capped:
            break
        level, capped = (row["all"] - (row["fixed"] or 0.0)) / row["free"], row["n"]
    return sources.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def _rate(size: Column, cap: float) -> Column:
    """Copies expected of a document: the tilt ``exp(tilt * size / mean)``, at most ``cap``."""
    tilted = F.exp(F.least(F.col("tilt") * size / F.col("mean"), F.lit(math.log(cap))))
    return F.when(F.col("full"), F.lit(cap)).when(size > 0, tilted).otherwise(F.lit(1.0))


@staged
def tilts(sizes: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Newton's method on the dual: one ``tilt`` per source, so that expected sizes meet the target.

    The rates minimise the entropy against one copy of each document under one constraint per source and the cap;
    the dual is convex in each tilt. A step is one aggregate over (source, size) counts, for all sources at once;
    where it leaves the bracket of the root, the bracket is halved. Steps go on until every source is met to a
    relative 1e-6 (60 at most; the bracket then has shrunk to nothing).
    """
    counts = materialize(sizes.where(F.col("size") > 0).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    least, ratio = F.col("least_size") / F.col("mean"), F.col("target") / F.col("source_size")
    up = ratio >= 1
    state = sources.withColumn("mean", F.col("source_size") / F.col("filled")).withColumns({
        "full": F.coalesce(F.col("target") >= F.lit(cap * (1 - 1e-9)) * F.col("source_size"), F.lit(True)),
        "tilt": F.lit(0.0),
        "low": F.when(up, F.lit(0.0)).otherwise(F.ln(ratio) / least),
        "high": F.when(up, F.lit(math.log(cap)) / least).otherwise(F.lit(0.0)),
    })
    state = materialize(state, "tilts")
    keep, x = state.columns, F.col("size") / F.col("mean")
    for _ in range(MAX_STEPS):
        open_ = state.where(~F.col("full"))
        rate = _rate(F.col("size"), cap)
        mass = F.col("n") * F.col("size") * rate
        sums = counts.join(small_side(open_), counts["source"].eqNullSafe(open_["source"])).groupBy(open_["source"]).agg(
            F.sum(mass).alias("got"), F.sum(F.when(rate < F.lit(cap), mass * x)).alias("slope")
        ).withColumnRenamed("source", "key")
        off = F.col("got") - F.col("target")
        joined = state.join(sums, state["source"].eqNullSafe(F.col("key")), "left").withColumns({
            "low": F.when(off < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(off > 0, F.col("tilt")).otherwise(F.col("high")),
        })
        step = F.col("tilt") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        done = F.coalesce(F.abs(off) <= F.lit(TOLERANCE) * F.col("target"), F.lit(True))
        moved = F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialize(joined.withColumns({"met": done, "tilt": F.when(done, F.col("tilt")).otherwise(moved)}).select(*keep, "met"), "tilts")
        if not state.where(~F.col("met")).limit(1).count():
            break
        state = state.drop("met")
    return state.select(*keep)


def document_copies(sizes: DataFrame, state: DataFrame, cap: float = CAP, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Whole ``copies`` per distinct ``doc_id, source, size``.

    Documents of a source are dealt by a hash of their id into chunks of about ``chunk_docs``. In a chunk they go
    from large to small, each rounded down or up, whichever brings the words taken so far closer to those expected;
    small documents make up for large ones. Rows of one id and size share one decision.
    """
    distinct = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    one = small_side(state.select("source", "docs", "tilt", "mean", "full").withColumnRenamed("source", "key"))
    rated = distinct.join(one, F.col("source").eqNullSafe(F.col("key"))).withColumns({
        "rate": _rate(F.col("size"), cap),
        "chunk": F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("docs") / F.lit(float(chunk_docs)))),
    })
    weight = (F.col("n") * F.col("size")).cast("double")
    item = F.struct((-weight).alias("order"), "doc_id", "size", "rate", weight.alias("w"))
    chunks = rated.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def step(acc: Column, i: Column) -> Column:
        down = F.floor(i["rate"] + F.lit(1e-9))
        error = acc["error"] + i["w"] * (down - i["rate"])
        more = (F.abs(error + i["w"]) < F.abs(error)) & (down < F.lit(cap))
        return F.struct(
            F.when(more, error + i["w"]).otherwise(error).alias("error"),
            F.array_append(acc["copies"], (down + more.cast("long")).cast("int")).alias("copies"),
        )

    start = F.struct(F.lit(0.0).alias("error"), F.array().cast("array<int>").alias("copies"))
    folded = chunks.withColumn("copies", F.aggregate("items", start, step)["copies"])
    pairs = folded.select("source", F.explode(F.arrays_zip("items", "copies")).alias("p"))
    return pairs.select(F.col("p.items.doc_id").alias("doc_id"), "source", F.col("p.items.size").alias("size"), F.col("p.copies").alias("copies"))


@staged
def plan_mix(docs: DataFrame, weight=cyclic_weight, cap: float = CAP) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies``.

    ``size`` is the number of words of ``text`` (0 for null or empty texts, which never count); copies are at most
    ``cap``. Null ids and null sources are values like others. The plan depends on ids, sources and sizes only, so
    reruns agree. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = materialize(rows, "mix-documents")
    sources = source_targets(sizes, weight, cap)
    copies = document_copies(sizes, tilts(sizes, sources, cap), cap)
    own = copies.select(*[F.col(c).alias(f"k_{c}") for c in copies.columns])
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size"))
    goal = small_side(sources.select(F.col("source").alias("g_source"), "source_size", "target"))
    return (
        sizes.join(own, same).join(goal, F.col("source").eqNullSafe(F.col("g_source")))
        .select("doc_id", "source", "size", "source_size", "target", F.col("k_copies").alias("copies"))
    )


def mix(docs: DataFrame, weight=cyclic_weight, cap: float = CAP) -> DataFrame:
    """``docs`` with every row repeated as often as the plan says (rows with no copy leave). Columns stay as they are;
    rows of one id, source and size are treated alike."""
    names = fresh(docs, "_mix_id", "_mix_source", "_mix_size", "_mix_copies", "_mix_words", "_mix_copy")
    mid, msource, msize, mcopies, words, copy = names
    plan = plan_mix(docs, weight, cap).groupBy("doc_id", "source", "size").agg(F.first("copies"))
    plan = plan.toDF(mid, msource, msize, mcopies).where(F.col(mcopies) > 0)
    same = docs["doc_id"].eqNullSafe(F.col(mid)) & docs["source"].eqNullSafe(F.col(msource)) & (F.col(words) == F.col(msize))
    kept = docs.withColumn(words, word_count(F.col("text"))).join(plan, same)
    return kept.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(mcopies)))).select(*docs.columns)
