"""Exact Jaccard self-join of shingle sets by token-combination prefixes, down to connected components.

Linked sets differ in few tokens: a set of n tokens has at most ``n - ceil(t n)`` that its partner lacks. So of any
``that + 1`` of its tokens, taken in one global order, the partner shares one, and has it in its own prefix. Order:
first the tokens that few documents have, rarest first, then the frequent ones. A rare token in a prefix is a
signature by itself. Frequent tokens are dealt into classes; a class of m prefix tokens gives all pairs of them, and
counts for m - 1 in the prefix length, which is extended accordingly. All of this looks only at the tokens with the
lowest hashes, twice a prefix on average: the argument holds within any such part. Sets too small for it there use the lowest
tokens of the whole set, among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, staged
from .common import batch_rows, fresh, materialize
from .components import components
from .pretokens import forget

WIDTH = 3
THRESHOLD = (90, 100)
CLASSES = 16
# A token of at least this share of the documents, and of FREQUENT_LEAST, is frequent; the shared set of them stays
# below FREQUENT_MOST.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 0.001, 2_000, 1_000_000
# Counters of a task that looks for frequent tokens: a power of two, far above the tokens of a set over the share.
BUCKETS = 1 << 20
# A bucket of at most PAIR_SETS gives its pairs; larger ones are compared inside tasks, BLOCK_SETS with as many others.
PAIR_SETS, BLOCK_SETS = 64, 1_000
# Sets of a block, and tokens, that are compared with all others of two blocks at once; whole sets sent to Python at once.
SLAB_SETS, SLAB_TOKENS, SET_ROWS = 256, 1_024, 128
# Rounds that compare a bucket's members with one of them only, before all pairs that are still apart.
STARS = 3

_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread bits over all 64 (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(30))) * _KEYS[0]
    x = (x ^ (x >> np.uint64(27))) * _KEYS[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct ``width``-word shingles, words between ASCII blanks, A-Z lower-cased; a
    shorter text is one shingle, a text without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, np.uint64(min(len(words), width)))
    for k in range(min(width, len(words))):
        out = _mixed(out * _KEYS[2] + hashed[k:k + n])
    return np.unique(out >> np.uint64(1)).astype(np.int64)


def allowed(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Tokens of a set of ``n`` that a linked set may lack."""
    return n - -(-threshold[0] * n // threshold[1])


def part_edge(threshold: tuple[int, int] = THRESHOLD) -> int:
    """Hashes below this are looked at: on average twice the tokens that a linked set may lack."""
    return int(min(1.0, 2 * (1 - threshold[0] / threshold[1])) * (1 << 63))


def sketch(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Stored ``doc_id, n, node, low, u``: set size, set hash, and the lowest tokens (those of the part, ``u`` of
    them, and at least a whole prefix)."""
    import xxhash

    edge = part_edge(threshold)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            n, node, low, u = [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, width)
                inside = int(np.searchsorted(tokens, edge))
                n.append(len(tokens))
                node.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None)
                low.append(tokens[:max(inside, allowed(len(tokens), threshold) + 1)])
                u.append(inside)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n": pa.array(n, pa.int32()), "node": pa.array(node, pa.int64()),
                "low": pa.array(low, pa.list_(pa.int64())), "u": pa.array(u, pa.int32()),
            })

    schema = "doc_id long, n int, node long, low array<long>, u int"
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema), "sketch")


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """Tokens of the part of all sets of a batch of ``low, u``, one set after the other."""
    low, u = batch.column(0), batch.column(1).to_numpy()
    size = np.diff(low.offsets.to_numpy())
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) < np.repeat(u, size)
    return low.flatten().to_numpy()[inside]


def frequent_tokens(nodes: DataFrame, share: float = FREQUENT_SHARE) -> np.ndarray:
    """Sorted tokens of the part that at least ``share`` of the sets have.

    A task first counts into ``BUCKETS`` counters by the tokens' last bits, whatever the number of tokens, and reports
    the buckets that are well filled there. Only tokens of buckets that are well filled in all are then counted.
    """
    total = max(nodes.count(), int(FREQUENT_LEAST / share))
    least = share * total

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, sets = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            counts += np.bincount(_parts(batch) & (BUCKETS - 1), minlength=BUCKETS)
            sets += batch.num_rows
        # What stays below half the share in every task does not reach the half that is asked for below by itself.
        full = np.flatnonzero(counts >= max(1, share * sets / 2))
        yield pa.RecordBatch.from_pydict({"bucket": full, "n": counts[full]})

    rows = nodes.select("low", "u")
    filled = rows.mapInArrow(loads, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least / 2)
    hot = np.zeros(BUCKETS, bool)  # the buckets are at most as many as a set has tokens, times two, over the share
    hot[filled.select("bucket").toPandas()["bucket"].to_numpy(np.int64)] = True
    shared = nodes.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            tokens = _parts(batch)
            token, n = np.unique(tokens[hot[tokens & (BUCKETS - 1)]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"token": token, "n": n})

    found = rows.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = materialize(found.where(F.col("n") >= least), "frequent")
    if found.count() > FREQUENT_MOST:
        return frequent_tokens(nodes, share * 4)
    return np.sort(found.select("token").toPandas()["token"].to_numpy(np.int64))


def _frequent_signatures(tokens: np.ndarray, need: int) -> tuple[list[int], bool]:
    """Pairs within classes of the shortest extended prefix of frequent tokens; whether it was long enough."""
    classes: dict[int, list[int]] = {}
    have = 0
    for token in tokens.tolist():
        held = classes.setdefault((token >> 8) % CLASSES, [])
        held.append(token)
        have += len(held) > 1
        if have >= need:
            break
    pairs = [p for held in classes.values() for p in combinations(held, 2)]
    if not pairs:
        return [], have >= need
    a, b = (np.array(x, np.uint64) for x in zip(*pairs))
    return (_mixed(a * _KEYS[2] + _mixed(b + _KEYS[3])) >> np.uint64(1)).astype(np.int64).tolist(), have >= need


def signature_rows(nodes: DataFrame, frequent: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``kind, key, node, meta``: kind 0 is a rare token of the part, kinds 1 and 2 are signatures already (pairs of
    frequent tokens; lowest tokens of sets too small for the part)."""
    shared = nodes.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            node, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            low, u = batch.column(2), batch.column(3).to_numpy()
            flat, at = low.values.to_numpy(), low.offsets.to_numpy()
            keys, kinds, owner, rares = [], [], [], []

            def put(kind, found, i, rare):
                keys.append(np.asarray(found, np.int64))
                kinds.append(np.full(len(found), kind, np.int8))
                owner.append(np.full(len(found), i))
                rares.append(np.full(len(found), rare))

            for i in range(len(node)):
                tokens, need = flat[at[i]:at[i + 1]], allowed(int(size[i]), threshold) + 1
                part = tokens[:u[i]]
                where = np.minimum(np.searchsorted(often, part), max(len(often) - 1, 0))
                hot = often[where] == part if len(often) else np.zeros(len(part), bool)
                rare = part[~hot]
                put(0, rare, i, len(rare))
                if len(rare) < need:
                    pairs, enough = _frequent_signatures(part[hot], need - len(rare))
                    put(1, pairs, i, len(rare))
                    if not enough:
                        put(2, tokens[:need], i, len(rare))
            own = np.concatenate(owner) if owner else np.empty(0, np.int64)
            own = own.astype(np.int64)
            join = lambda x, t: np.concatenate([np.empty(0, t), *x]).astype(t)
            yield pa.RecordBatch.from_pydict({
                "kind": join(kinds, np.int8), "key": join(keys, np.int64), "node": node[own],
                "meta": (size[own].astype(np.int64) << 32) | join(rares, np.int64),
            })

    return nodes.select("node", "n", "low", "u").mapInArrow(rows, "kind byte, key long, node long, meta long")


def _meta():
    """Set size and number of rare tokens, which travel as one number."""
    meta = F.col("meta")
    return [F.shiftright(meta, 32).cast("int").alias("n"), meta.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("rare")]


def signatures(nodes: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Stored ``sig, node, n, pos`` of signatures that more than one set has. ``pos`` is the place of a rare token in
    the order of its set (0 for other signatures)."""
    rows = signature_rows(nodes, frequent_tokens(nodes), threshold)
    # Frequent tokens are not among the rows of kind 0, so their groups are bounded by the share.
    shared = rows.where(F.col("kind") == 0).select("key", "node", "meta").withColumn(
        "df", F.count(F.lit(1)).over(Window.partitionBy("key"))
    ).where(F.col("df") > 1)
    shared = materialize(shared.select("key", "df", "node", *_meta()), "shared-tokens")
    need = F.col("n") - F.ceil(F.col("n") * F.lit(threshold[0]) / F.lit(threshold[1])) + 1
    chosen = shared.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "key"))).alias("tokens"), F.max("n").alias("n"), F.max("rare").alias("rare"),
    )
    # Tokens no other set has come first in the order; they take up the prefix before these do.
    left = (need - (F.col("rare") - F.size("tokens"))).cast("int")
    rare = chosen.where(left > 0).select(
        "node", "n", (F.col("rare") - F.size("tokens")).alias("own"), F.posexplode(F.slice("tokens", F.lit(1), left)).alias("at", "t")
    ).select(F.lit(0).cast("byte").alias("kind"), F.col("t.key").alias("key"), "node", "n", (F.col("own") + F.col("at")).alias("pos"))
    every = rare.unionByName(rows.where(F.col("kind") > 0).select("kind", "key", "node", _meta()[0], F.lit(0).alias("pos")))
    sig = materialize(every.select(F.xxhash64("kind", "key").alias("sig"), "node", "n", "pos"), "signatures")
    many = sig.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("sig")
    return materialize(sig.join(many, "sig"), "buckets")


def verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The ``a, b`` pairs that are linked, by their whole sets."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i) for i in (2, 3)]
            flat, at = [s.values.to_numpy() for s in sides], [s.offsets.to_numpy() for s in sides]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (flat[s][at[s][i]:at[s][i + 1]] for s in (0, 1))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = threshold[1] * both >= threshold[0] * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(linked, "a long, b long")


def _possible(x, y, threshold):
    """Whether two sets that share this signature first can be linked at all: their sizes are near enough, and neither
    has more tokens before it, which the other lacks, than a linked set may."""
    part, whole = threshold
    common = F.ceil((x["n"] + y["n"]) * F.lit(part) / F.lit(part + whole))
    sized = F.least(x["n"], y["n"]) * F.lit(whole) >= F.greatest(x["n"], y["n"]) * F.lit(part)
    return sized & (x["pos"] <= x["n"] - common) & (y["pos"] <= y["n"] - common)


def _overlaps(rows: list[tuple], possible: np.ndarray) -> np.ndarray:
    """Common tokens of the possible pairs of rows; other cells are of no use."""
    m = len(rows)
    out = np.zeros((m, m), np.float32)  # whole numbers far below the 24 bits that it holds exactly
    if possible.sum() <= 40 * m:
        for i, j in zip(*np.nonzero(possible)):
            x, y = rows[i][5], rows[j][5]
            out[i, j] = len(x) + len(y) - len(np.union1d(x, y))
        return out
    tokens, at, n = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m, dtype=np.int32), [len(r[5]) for r in rows])
    shared = n[at] > 1
    column = np.cumsum(n > 1) - 1
    at, owner = column[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for begin in range(0, int((n > 1).sum()), SLAB_TOKENS):
        low, high = np.searchsorted(at, (begin, begin + SLAB_TOKENS))
        part = np.zeros((m, SLAB_TOKENS), np.float32)
        part[owner[low:high], at[low:high] - begin] = 1
        out += part @ part.T
    return out


def _bucket_links(rows: list[tuple], same_block: bool, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between members with different labels, at most one less than there are members. Pairs are judged a slab of
    rows at a time; of all pairs there are only one bit and one overlap."""
    part, whole = threshold
    node, n, pos, label, block = (np.array([r[k] for r in rows]) for k in range(5))
    n, pos, at = n.astype(np.int64), pos.astype(np.int64), np.arange(len(rows))
    slabs = [slice(k, min(k + SLAB_SETS, len(rows))) for k in range(0, len(rows), SLAB_SETS)]
    possible = np.zeros((len(rows), len(rows)), bool)
    for own in slabs:
        total = n[own, None] + n[None, :]
        common = -(-part * total // (part + whole))
        fits = (label[own, None] != label[None, :]) & (at[own, None] < at[None, :])
        fits &= (pos[own, None] <= n[own, None] - common) & (pos[None, :] <= n[None, :] - common)
        fits &= np.minimum(n[own, None], n[None, :]) * whole >= np.maximum(n[own, None], n[None, :]) * part
        if not same_block:
            fits &= block[own, None] != block[None, :]
        possible[own] = fits
    if not possible.any():
        return []
    both = _overlaps(rows, possible)
    root = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for own in slabs:
        common = both[own].astype(np.int64)
        linked = possible[own] & (whole * common >= part * (n[own, None] + n[None, :] - common))
        for i, j in zip(*np.nonzero(linked)):
            i += own.start
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return out


def apart_links(held: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Stored ``a, b`` links between members of one bucket that are still in different components.

    Every pair is looked at, inside tasks: a bucket is cut into blocks of about ``BLOCK_SETS``, and a task has two
    blocks with their sets. What leaves it is a spanning part of the links it finds, never a pair that is none.
    """
    counts = held.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_SETS))).cast("int").alias("blocks"))
    dealt = held.join(counts, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.join(sets, "node").select(
        "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "pos", "label",
        F.col("own").alias("block"), "tokens",
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def links() -> list[tuple[int, int]]:
            return _bucket_links(members, group[1] == group[2], threshold) if len(members) > 1 else []

        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            plain = list(zip(*(batch.column(k).to_pylist() for k in range(3, 8))))
            flat, at = batch.column(8).values.to_numpy(), batch.column(8).offsets.to_numpy()
            for k, key in enumerate(keys):
                if key != group:
                    found += links()
                    group, members = key, []
                members.append((*plain[k], flat[at[k]:at[k + 1]].copy()))
            yield _pairs(found)
        yield _pairs(links())

    ordered = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return materialize(ordered.mapInArrow(solve, "a long, b long").distinct(), "links")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([p[i] for p in found], pa.int64()) for i, k in enumerate(("a", "b"))})


@staged
def set_links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Stored ``node, label`` of all sets with a link; distinct sets only."""
    # A first round on the part finds the sets that may have partners; a second one ranks all tokens of those.
    first = signatures(nodes, threshold)
    wanted = first.select("node").distinct().join(nodes.select("node", "doc_id", "n"), "node").select("node", "doc_id")
    wanted = materialize(wanted, "candidates")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column(1).to_pylist()]
            node = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            same = pa.array([a == b for a, b in zip(node, batch.column(0).to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "tokens": pa.array(sets, pa.list_(pa.int64()))})
            yield out.filter(same)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(wanted), "doc_id").select("node", "text")
    # One text of each id and set; rows that repeat them give the same set again.
    sets = materialize(texts.mapInArrow(whole, "node long, tokens array<long>"), "sets")
    if sets.count() > wanted.count():
        sets = materialize(sets.dropDuplicates(["node"]), "sets")
    size = F.size("tokens")
    buckets = signatures(sets.select("node", size.alias("n"), F.col("tokens").alias("low"), size.alias("u")), threshold)
    links = labels = done = None
    for turn in range(STARS + 1):
        if labels is None:
            held = buckets.withColumn("label", F.col("node"))
        else:
            held = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            apart = held.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size"))
            apart = apart.where(F.col("x") != F.col("y")).select("sig", "size")
            held = materialize(held.join(apart, "sig"), "apart")
        row = F.struct("pos", "n", "node", "label")
        if turn < STARS:
            # The member with the fewest tokens before the signature is likely to be what the others were copied from.
            order = F.struct("pos", F.xxhash64("node", F.lit(turn)).alias("turn"), row.alias("row"))
            centre = held.groupBy("sig").agg(F.min(order).alias("c")).select("sig", F.col("c.row").alias("y"))
            sides = held.select("sig", row.alias("x")).join(centre, "sig")
            pairs = sides.where((F.col("x.label") != F.col("y.label")) & _possible(F.col("x"), F.col("y"), threshold))
        else:
            # Members of one component are never compared with each other.
            links = links.unionByName(apart_links(held.where(F.col("size") > PAIR_SETS), sets, threshold))
            few = held.where(F.col("size") <= PAIR_SETS)
            x, y = few.select("sig", row.alias("x")), few.select("sig", row.alias("y"))
            pairs = x.join(y, (x["sig"] == y["sig"]) & (F.col("x.label") < F.col("y.label")) & _possible(F.col("x"), F.col("y"), threshold))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        new = materialize(verify(pairs, sets, threshold), "links")
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    return components(links)


@staged
def jaccard_components(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two rows are linked when the Jaccard index of their shingle sets is at least ``threshold`` (a fraction of whole
    numbers); the component is the smallest id reachable by links, the own one included. Equal sets meet by their
    hash before anything else, so copies are never compared. Null, empty and blank texts have no shingles and no
    links. A row with a null id has the component of its set and never names one; if none of them has an id, null.
    Every row of a repeated id is a set of its own. An empty table gives no rows; other columns are not looked at.
    """
    with batch_rows(docs.sparkSession, SET_ROWS):
        rows = sketch(docs, width, threshold)
        filled = rows.where(F.col("n") > 0)
        classes = filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
        classes = materialize(classes, "classes")
        # A class is looked at once: by its smallest id, or by any row if it has none.
        copies = small_side(classes.where(F.col("rows") > 1).select("node", "first"))
        single = filled.join(copies.select("node"), "node", "left_anti")
        own = filled.join(copies, "node").where(F.col("doc_id").eqNullSafe(F.col("first"))).drop("first").dropDuplicates(["node"])
        nodes = single.unionByName(own.select(*single.columns)).where(F.col("doc_id").isNotNull())
        labels = set_links(docs.where(F.col("doc_id").isNotNull()), nodes, width, threshold)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    found = named.join(least, "label").select("node", "component_id")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node").join(found, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with the row of the smallest id of every component, and all rows without words or without an id."""
    found = jaccard_components(docs, width, threshold).where(F.col("doc_id") != F.col("component_id"))
    (gone,) = fresh(docs, "_gone")
    gone_ids = small_side(materialize(found.select(F.col("doc_id").alias(gone)).distinct(), "near-copies"))
    return docs.join(gone_ids, docs["doc_id"] == F.col(gone), "left_anti")
