"""Ranked lexical search against brute force, case by case."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from linkops.llm import lexical
from linkops.llm.lexical import _Best, _Block, search, search_block, terms, weight

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top):
    """Rows ``item_id, rank, doc_id, score`` of every item, in plain Python."""
    held = [(i, Counter(cut(t))) for i, t in docs]
    total, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        asked, scored = Counter(cut(text)), []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * total) // length if c else 0
            score = sum(k * weight(total, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_terms_are_runs_of_digits_letters_and_other_characters():
    text = "Über-ÄPFEL_x9, a b—C\x7f d"
    assert [t.decode() for t in terms(text.encode())] == cut(text) and terms(None) == []


def corpus(seed, n):
    pick = random.Random(seed)
    words = [f"w{int(pick.paretovariate(0.7))}" for _ in range(60 * n)]
    docs = [(i, " ".join(words[i * 60:i * 60 + pick.choice([0, 1, 5, 30, 60])])) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(n // 3)] + [(None, docs[3][1]), (None, "w1"), (5, docs[5][1]), (5, docs[5][1])]
    return docs + [(-1, None), (-2, ""), (-3, " .,; "), (-4, "w1 " * 40_000 + "w2")]


def items_of(seed, n):
    pick = random.Random(seed)
    items = [(i, " ".join(f"w{int(pick.paretovariate(0.5))}" for _ in range(pick.choice([1, 3, 12, 90])))) for i in range(n)]
    return items + [items[0], (0, "w1 w1 w2"), (None, "W1, w3"), (90, None), (91, ""), (92, "nowhere"), (93, "w1 " * 30 + "w2 w3")]


@pytest.mark.parametrize("pairs", [250_000, 20])
def test_search_equals_brute_force(spark, pairs):
    docs, items = corpus(1, 300), items_of(2, 12)
    d, i = frames(spark, docs, items)
    assert rows(search(d, i, 4, pairs)) == brute(docs, items, 4)


def test_equal_scores_go_by_number_and_null_comes_last(spark):
    docs = [(9, "a b"), (None, "a b"), (2, "a b"), (2, "a b"), (4, "c"), (5, "d")]
    d, i = frames(spark, docs, [(1, "a")])
    assert [r[1:3] for r in sorted(rows(search(d, i, 3)), key=lambda r: r[1])] == [(1, 2), (2, 2), (3, 9)]
    assert [r[2] for r in sorted(rows(search(d, i, 10)), key=lambda r: r[1])] == [2, 2, 9, None]


def test_empty_tables_and_extra_columns(spark):
    d, i = frames(spark, [(1, "a")], [(1, "a")])
    assert rows(search(d.where("false"), i)) == [] and rows(search(d, i.where("false"))) == []
    assert rows(search(d.selectExpr("*", "1 AS n", "'x' AS terms", "2 AS item_id"), i.selectExpr("*", "3 AS item", "4 AS rank", "5 AS doc_id"))) == brute([(1, "a")], [(1, "a")], 10)


def test_masks_are_left_out_only_when_they_cannot_matter():
    """Many blocks of one term each: once the best are known, no group of lower bound is scored."""
    best, count = _Best(2), np.array([1, 1], np.int64)
    rich = _Block(np.arange(4), np.zeros(4, bool), np.array([0, 2, 4, 5, 6]), np.array([0, 1, 0, 1, 0, 1]), np.array([9, 9, 8, 8, 1, 1]))
    assert search_block(rich, np.array([0, 1]), np.array([1, 1]), count, best) == 4
    poor = _Block(np.arange(4, 8), np.zeros(4, bool), np.array([0, 1, 2, 3, 4]), np.array([0, 0, 1, 1]), np.array([15, 2, 15, 3]))
    assert search_block(poor, np.array([0, 1]), np.array([1, 1]), count, best) == 0
    tie = _Block(np.array([-1]), np.zeros(1, bool), np.array([0, 1]), np.array([0]), np.array([16]))
    assert search_block(tie, np.array([0, 1]), np.array([1, 1]), count, best) == 1 and best.ids.tolist() == [0, -1]


def test_large_lengths_are_exact():
    n = np.array([10 ** 9, 3], np.int64)
    assert lexical.length_factors(n, 10 ** 9, 7 * 10 ** 17).tolist() == [25 + 75 * v * 10 ** 9 // (7 * 10 ** 17) for v in n.tolist()]
