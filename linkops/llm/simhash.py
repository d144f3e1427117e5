"""SimHash near copies by anchor-point covering.

Fingerprints that differ in at most ``threshold`` bits differ in at most half as many in one of their two halves. In
each half the anchors are the words of the perfect Hamming code of 31 bits, a covering code of radius 1: every half has
an anchor, its home, within distance 1, and whatever is within the half's threshold of it lies within the threshold
plus 1 of that home. So a fingerprint goes to every anchor within radius plus threshold, sixteen of them for one bit,
and each anchor compares what came to it. Of the 2^26 anchors of a half only those matter that hold a home and something
else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staged
from .common import batch_rows, materialize
from .components import components

WIDTH = 3
THRESHOLD = 3
SEED = 42
# Bits of a half that the code covers; the last bit of each half takes no part in the choice of anchors.
CODE_BITS = 31
# Large anchors are compared in blocks of about so many fingerprints on either side.
BLOCK = 2_048
# Shingles whose bits are counted at once, and whole texts sent to Python at once.
SHINGLES, TEXT_ROWS = 65_536, 512


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """64-bit fingerprint, unsigned: a bit is set if it is set in over half the hashes of the ``width``-word shingles,
    repeats included. Words stand between ASCII blanks, A-Z lower-cased; a shorter text is one shingle, none is 0."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, SHINGLES):
        part = words[start:start + SHINGLES + width - 1]
        parts = zip(*(part[k:] for k in range(width)))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stored ``doc_id, fp`` of every row; the fingerprint's 64 bits as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    with batch_rows(docs.sparkSession, TEXT_ROWS):
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return materialize(out.mapInArrow(rows, "doc_id long, fp long"), "fingerprints")


def coset_words(reach: int) -> list[list[int]]:
    """For each syndrome of the code the bit patterns of weight ``reach`` at most that lead to a code word, the one of
    least weight first. Bit i has the syndrome i + 1."""
    out: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for size in range(reach + 1):
        for bits in combinations(range(CODE_BITS), size):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1
            out[syndrome].append(sum(1 << b for b in bits))
    return out


def anchored(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``key, fp, home`` for each anchor that a fingerprint ``fp`` goes to; ``key`` names the half and the anchor."""
    words = F.array(*[F.array(*[F.lit(w).cast("long") for w in ws]) for ws in coset_words(1 + threshold // 2)])
    out = None
    for half in range(2):
        own = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
        syndrome = F.lit(0)
        for bit in range(5):
            mask = sum(1 << i for i in range(CODE_BITS) if (i + 1) >> bit & 1)
            syndrome = syndrome + (F.bit_count(F.col("_half").bitwiseAND(F.lit(mask))) % 2) * (1 << bit)
        rows = fps.select("fp", own.alias("_half")).select("fp", "_half", F.posexplode(F.get(words, syndrome)).alias("_i", "_word"))
        key = F.col("_half").bitwiseXOR(F.col("_word")).bitwiseOR(F.lit(half << 32))
        rows = rows.select(key.alias("key"), "fp", (F.col("_i") == 0).alias("home"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _block_links(fps: np.ndarray, labels: np.ndarray, seeks: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between seekers and members of different labels that join all labels they reach, one for each joint."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    mine, others = np.nonzero(seeks)[0], np.nonzero(~seeks)[0]
    for start in range(0, len(mine), 256):
        rows = mine[start:start + 256]
        near = np.bitwise_count(fps[rows, None] ^ fps[None, others]) <= threshold
        near &= labels[rows, None] != labels[None, others]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        pairs = np.stack([labels[rows[i]], labels[others[j]]], axis=1)
        _, one = np.unique(pairs, axis=0, return_index=True)
        for k in one.tolist():
            a, b = find(int(pairs[k, 0])), find(int(pairs[k, 1]))
            if a != b:
                root[a] = b
                out.append((int(fps[rows[i[k]]]), int(fps[others[j[k]]])))
    return out


def _links_apart(held: DataFrame, labels: DataFrame, threshold: int, block: int) -> DataFrame:
    """Links between members of an anchor that are still in different components, in blocks of bounded size.

    Of any two such members at least one is not in the component of the anchor's centre; these seek among all.
    """
    label = labels.select(F.col("node").alias("fp"), "label")
    named = materialize(held.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    centre = F.max(F.when(F.col("fp") == F.col("centre"), F.col("label")))
    sizes = named.groupBy("key").agg(
        centre.alias("main"), F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"),
    ).where(F.col("low") != F.col("high"))
    part = named.select("key", "fp", "label").join(small_side(materialize(sizes.select("key", "main", "n"), "apart")), "key")
    part = materialize(part, "apart-members")
    seekers = part.where(F.col("label") != F.col("main"))
    count = materialize(seekers.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "seekers")
    part = part.join(small_side(count), "key").withColumns({"rows": F.ceil(F.col("m") / block), "cols": F.ceil(F.col("n") / block)})
    deal = F.xxhash64("fp", F.lit(1))
    own, other = F.pmod(deal, F.col("rows")), F.pmod(deal, F.col("cols"))
    left = part.where(F.col("label") != F.col("main")).select(
        "key", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("j"), "fp", "label", F.lit(True).alias("seeks"),
    )
    right = part.select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), other.alias("j"), "fp", "label", F.lit(False).alias("seeks"),
    )
    dealt = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compare() -> pa.RecordBatch:
            cols = np.concatenate(held, axis=1)
            found = _block_links(cols[3], cols[4], cols[5].astype(bool), threshold)
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        for batch in batches:
            cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)])
            cuts = np.nonzero((cols[:3, 1:] != cols[:3, :-1]).any(axis=0))[0] + 1
            for k, piece in enumerate(np.split(cols, cuts, axis=1)):
                if held and (held[-1][:3, -1] != piece[:3, 0]).any():
                    yield compare()
                    held.clear()
                held.append(piece)
        if held:
            yield compare()

    return dealt.mapInArrow(rows, "a long, b long")


@staged
def fingerprint_components(fps: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Stored ``node, label`` of the distinct fingerprints ``fp`` that have links; the label is the smallest fingerprint
    reachable by links of at most ``threshold`` different bits.

    First every member of an anchor is compared with one fingerprint at home there, which joins most of a dense
    cluster without looking at pairs; then only members that are still apart are compared, in blocks.
    """
    members = anchored(fps, threshold)
    busy = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("home"), F.col("fp"))).alias("centre"),
        F.min("fp").alias("low"), F.max("fp").alias("high"),
    ).where((F.col("n") > 1) & F.col("centre").isNotNull())
    # Two members are a link or nothing, without a look at the rest.
    busy = busy.where((F.col("n") > 2) | (_distance(F.col("low"), F.col("high")) <= threshold))
    busy = materialize(busy.select("key", "centre"), "busy")
    held = materialize(members.select("key", "fp").join(small_side(busy), "key"), "held")
    stars = held.where((F.col("fp") != F.col("centre")) & (_distance(F.col("fp"), F.col("centre")) <= threshold))
    stars = materialize(stars.select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct(), "stars")
    labels = components(stars)
    links = materialize(_links_apart(held, labels, threshold, block), "links")
    return components(stars.unionByName(links))


@staged
def simhash_components(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Stored ``doc_id, fingerprint, component_id``, one row for each row of ``docs`` (``doc_id``, ``text``).

    Rows are linked when their fingerprints differ in at most ``threshold`` bits; ``component_id`` is the smallest
    ``doc_id`` reachable by links. Texts that are null, empty or without words have the fingerprint zero and are linked
    like any other. A null ``doc_id`` is a row of its own fingerprint; it is nobody's component, unless no id is in
    reach, when the component is null. Repeated rows stay. Other columns are not looked at.
    """
    prints = fingerprints(docs, width)
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    nodes = fingerprint_components(distinct.select("fp"), threshold)
    linked = nodes.withColumnRenamed("node", "fp").join(distinct, "fp")
    roots = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = linked.select("fp", "label").join(roots, "label").select("fp", "component_id")
    copies = distinct.where(F.col("n") > 1).join(nodes, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("first").alias("component_id"))
    # A fingerprint of one row without links is its own component; all others are looked up.
    groups = small_side(materialize(linked.unionByName(copies).withColumn("found", F.lit(True)), "groups"))
    return prints.join(groups, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
