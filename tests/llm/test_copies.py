"""Repeated substrings, set joins, components and neighbours against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n=60):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeé ") for _ in range(pick.randint(1, 9)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = " ".join(word() for _ in range(pick.randint(0, 80)))
        if pick.random() < 0.5:
            s = pick.choice(shared)
            at, cut = pick.randint(0, len(t)), pick.randint(0, len(s))
            t = t[:at] + s[:cut] + pick.choice(["", "X"]) + s[cut:] + t[at:]
        texts.append(t)
    return texts + [texts[0], texts[3], None, "", "a" * 700, "a" * 90, "ab" * 300, "x" * 199, "abc" * 60 + "q" + "abc" * 60]


@pytest.mark.parametrize("seed, length, group, block", [(1, 40, 1 << 20, 1 << 20), (2, 41, 1, 64), (3, 200, 1 << 20, 300), (4, 40, 300, 1 << 20)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, length, group, block):
    from linkops.llm import suffixes

    monkeypatch.setattr(suffixes, "GROUP_BYTES", group)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", min(group, 5_000))
    monkeypatch.setattr(suffixes, "BLOCK", block)
    texts = passages(seed)
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").withColumnRenamed("n_bytes", "row")
    got = {r["row"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs, length, True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, length)


def test_progressions_hold_every_place_once():
    from linkops.llm.suffixes import _progressions

    pick = np.random.default_rng(5)
    run = np.sort(pick.integers(0, 4, 3_000))
    place = np.concatenate([np.arange(n) for n in np.bincount(run, minlength=4)])
    name = np.where(run < 2, place % 3, pick.integers(0, 50, 3_000)).astype(np.uint64)
    at, step, n = _progressions(name, run, place)
    got = sorted((run[a], name[a], place[a] + i * s) for a, s, k in zip(at, step, n) for i in range(k))
    assert got == sorted(zip(run, name, place))
    assert sum(run[a] < 2 for a in at) == 6  # a periodic run takes a row for each place of its period


def test_texts_of_one_repeated_character(spark):
    """A thousand padded texts of different lengths share one rank; its bytes go through no single task."""
    from linkops.llm.suffixes import remove_repeats

    rows = [(i, "-" * (15_000 + 7 * i)) for i in range(1_000)] + [(5_000, "xy" * 9_000), (5_001, "z" * 200), (5_002, "w" * 201)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest_only=True).collect()}
    assert all(got[i] == (len(t), len(t), 1) for i, t in rows if i != 5_001) and got[5_001] == (200, 0, 0)


def test_repeats_beside_columns_of_any_name(spark):
    from linkops.llm.suffixes import remove_repeats

    docs = spark.createDataFrame([(1, "q" * 300)], "doc_id long, text string")
    wide = docs.selectExpr("*", *[f"1 AS {c}" for c in ("_text", "_text2", "_text3", "_span_key", "_row_key", "_rows", "spans", "key")])
    assert [r["n_removed"] for r in remove_repeats(wide).collect()] == [300]


def test_repeats_keep_rows_and_bytes(spark):
    from linkops.llm.suffixes import remove_repeats

    docs = spark.createDataFrame([(1, "p" * 30 + "q" * 300, "x"), (1, "r" * 30, "y")], "doc_id long, text string, KEPT string")
    got = {r["doc_id"]: r for r in remove_repeats(docs.limit(1)).collect()}
    assert bytes(got[1]["kept"]) == b"p" * 30 and got[1]["text"] is not None
    assert remove_repeats(docs.limit(0)).count() == 0


def brute_components(rows, width, threshold):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and threshold[1] * both >= threshold[0] * len(a | sets[j]):
                root[find(i)] = find(j)
    label = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            label[find(k)] = min(i, label.get(find(k), i))
    return sorted(((i, len(sets[k]), label.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed):
    pick = random.Random(seed)
    word = lambda: pick.choice("abcdefgh") + pick.choice("ijklmnop") + str(pick.randint(0, 30))
    rows, k = [], 100
    for _ in range(25):
        base = [word() for _ in range(pick.randint(1, 120))]
        for _ in range(pick.choice([1, 1, 2, 8, 20])):
            copy = [w if pick.random() > pick.choice([0, 0.01, 0.03]) else word() for w in base]
            rows.append((k, pick.choice([" ", "\n"]).join(copy)))
            k += pick.choice([1, 3])
    pick.shuffle(rows)
    rows += [(1, None), (2, ""), (3, " \t"), (4, "two words"), (5, "TWO  words"), (None, rows[0][1]), (rows[1][0], rows[2][1]), rows[3], (6, "a b c"), (7, "a b c a b c")]
    return rows


@pytest.mark.parametrize("seed, width, threshold, least, pair", [(1, 3, (90, 100), 2_000, 64), (2, 3, (90, 100), 3, 2), (3, 5, (80, 100), 2, 2), (4, 2, (1, 2), 5, 64)])
def test_components_equal_brute_force(spark, monkeypatch, seed, width, threshold, least, pair):
    from linkops.llm import jaccard

    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", least)
    monkeypatch.setattr(jaccard, "PAIR_SETS", pair)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 6)
    monkeypatch.setattr(jaccard, "STARS", 1)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, N int")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs, width, threshold).collect()), key=str)
    assert got == brute_components(rows, width, threshold)


def test_one_document_of_each_group_stays(spark):
    from linkops.llm.jaccard import jaccard_components, one_per_component

    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (9, "x y z"), (None, "a b c d e f"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in one_per_component(docs).collect()) == ["2", "8", "9", "None"]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    from linkops.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_nearest(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in good:
        if q in asked:
            near = sorted((-float(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(near)}
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    from linkops.llm import neighbours

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(12)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, [2.0, 1.0]), (401, [1.0, 2.0]), (402, None), (403, []), (404, [0.0] * 12), (405, [float("nan")] * 12),
             (406, [None] + [1.0] * 11), (407, [float("inf")] * 12), (None, rows[1][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    asked = {i for i, _ in rows if i is not None and (i % 10 == 7 or i >= 300)}
    queries = table.where("vec_id % 10 = 7 OR vec_id >= 300")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(table, queries, 5).collect()}
    assert got == brute_nearest(single, asked, 5)
    monkeypatch.setattr(neighbours, "LEAST", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    few = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(table, queries, 5, power=0.1).collect()}
    want = {(q, i) for q, _, i in brute_nearest(single, asked, 5)}
    assert len(few & want) > 0.6 * len(want)
    assert neighbours.nearest(table.limit(0), queries.limit(0)).count() == 0


def test_frequent_tokens_are_exact(spark, monkeypatch):
    """Counted over all sets, though tasks count into few buckets first; only the first ``u`` tokens of a set count."""
    from linkops.llm import jaccard

    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 1)
    monkeypatch.setattr(jaccard, "BUCKETS", 64)
    pick, sets = random.Random(12), []
    for i in range(400):
        tokens = sorted({int(pick.paretovariate(0.4)) * 7 for _ in range(pick.randrange(0, 40))})
        sets.append((tokens, pick.randrange(0, len(tokens) + 1)))
    df = spark.createDataFrame(sets, "low array<long>, u int").repartition(7)
    counts = Counter(t for low, u in sets for t in low[:u])
    for share in (0.01, 0.05, 0.3):
        assert jaccard.frequent_tokens(df, share).tolist() == sorted(t for t, n in counts.items() if n >= share * 400)
    assert jaccard.frequent_tokens(df.where("false"), 0.05).tolist() == []


def test_recall_inside_and_outside_a_dense_cluster(spark):
    """A third of 30,000 rows lies around one direction, the rest is near-isotropic; either has its recall."""
    from linkops.llm.neighbours import nearest

    pick, n, dim = np.random.default_rng(21), 30_000, 64
    x = pick.standard_normal((n, dim))
    centre = pick.standard_normal(dim)
    x[: n // 3] = centre + 0.6 * x[: n // 3]
    asked = np.concatenate([pick.choice(n // 3, 50, False), n // 3 + pick.choice(n - n // 3, 50, False)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    seen = unit[asked] @ unit.T
    seen[np.arange(100), asked] = -2
    want = np.argsort(-seen, axis=1)[:, :5]
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}), "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(table, table.where(table["vec_id"].isin(asked.tolist())), 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.array([len(got[q] & set(w)) / 5 for q, w in zip(asked.tolist(), want.tolist())])
    assert recall[:50].mean() >= 0.9 and recall[50:].mean() >= 0.9, (recall[:50].mean(), recall[50:].mean())
