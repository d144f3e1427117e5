"""SimHash components against brute force, case by case."""

import random

import numpy as np
import xxhash

from linkops.llm.simhash import CODE_BITS, _block_links, coset_words, fingerprint, fingerprint_components, simhash_components


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs, threshold=3):
    """Rows ``doc_id, fingerprint, component_id`` by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in docs]
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (d, _), c in zip(docs, comp):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(docs, fps, comp)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprints(spark):
    texts = [None, "", " \t", "One", "one two", "One two THREE", "a b c d e " * 700, "ä b c\x1cd e", "x " * 70_000]
    assert [fingerprint(None if t is None else t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    # The same hash as Spark's own.
    df = spark.createDataFrame([("one two three",)], "t string").selectExpr("xxhash64(t) AS h")
    assert df.first()["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_the_code_covers_and_reaches():
    words = coset_words(2)
    assert all(len(w) == (16 if s else 1) for s, w in enumerate(words)) and [w[0].bit_count() for w in words] == [0] + [1] * CODE_BITS

    def anchors(x):
        syndrome = 0
        for b in range(CODE_BITS):
            if x >> b & 1:
                syndrome ^= b + 1
        return [x ^ w for w in words[syndrome]]

    pick = random.Random(5)
    for _ in range(200):
        x = pick.getrandbits(CODE_BITS)
        y = x ^ (1 << pick.randrange(CODE_BITS))
        assert anchors(x)[0] in anchors(y) and anchors(y)[0] in anchors(x) and anchors(x)[0] in anchors(x)


def test_pairs_at_every_distance_are_found(spark):
    pick, fps, want = random.Random(3), [], []
    for k in range(240):
        a = pick.getrandbits(64)
        b = a
        for bit in pick.sample(range(64), k % 6):
            b ^= 1 << bit
        fps += [a, b]
        want.append(k % 6)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    label = {r["node"]: r["label"] for r in fingerprint_components(df).collect()}
    for k, d in enumerate(want):
        a, b = signed[2 * k], signed[2 * k + 1]
        assert (d == 0) or (label.get(a, a) == label.get(b, b)) == (d <= 3)


def test_dense_clusters_in_small_blocks(spark):
    """Chains and clouds around a few centres, where anchors are large and stars do not join everything."""
    pick, fps = random.Random(4), set()
    for centre in (0, pick.getrandbits(64), pick.getrandbits(64)):
        for _ in range(160):
            f = centre
            for bit in pick.sample(range(64), pick.choice([1, 2, 3, 4, 5])):
                f ^= 1 << bit
            fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    comp = {f: f for f in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                comp[find(a)] = find(b)
    label = {r["node"]: r["label"] for r in fingerprint_components(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, 7).collect()}
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(find(f), set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_a_block_gives_one_link_for_each_joint():
    fps = np.array([0, 1, 3, 1 << 40, 0, 1, 3, 1 << 40], np.int64)
    seeks = np.array([True] * 4 + [False] * 4)
    links = _block_links(fps, fps.copy(), seeks, 1)
    assert len(links) == 3 and all((a ^ b).bit_count() <= 1 for a, b in links)


def test_documents_equal_brute_force(spark):
    pick = random.Random(6)
    base = [" ".join(pick.choice(["alpha", "beta", "gamma", "delta", "Omega", "über"]) + str(pick.randrange(30)) for _ in range(80)) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = pick.choice(base).split()
        for _ in range(i % 3):
            words[pick.randrange(len(words))] = "new"
        docs.append((100 + i, " ".join(words)))
    docs += [(-5, None), (3, ""), (7, " \n "), (None, base[0]), (None, "only here"), (900, "one"), (901, "One"), (8, base[1]), (8, base[1]), (950, "w " * 60_000)]
    docs += [(2_000 + i, base[2]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(simhash_components(df)) == brute(docs)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    assert rows(simhash_components(df.where("false"))) == []
    wide = df.selectExpr("*", "7 AS fp", "'x' AS found", "1 AS component_id", "2 AS label", "3 AS n")
    assert rows(simhash_components(wide)) == brute([(1, "a b c d"), (2, "a b c d"), (3, None)])
