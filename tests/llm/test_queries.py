"""The registered queries over the smallest driver tables, and the pipeline stage by stage."""

import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_copies import brute_components, brute_nearest, brute_removed  # noqa: E402
from test_text_scans import brute_hits, brute_targets  # noqa: E402
from test_tokens_chat import BYTE, WORD, library  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queries():
    import __spark_entry__ as entry

    return entry.queries()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted((r["doc_id"], r["text"], r["source"]) for r in rows)


@pytest.mark.parametrize("key", ["op1_decontamination", "op4_licence_scan", "op13_lexical_search"])
def test_query_equals_sql(spark, queries, key):
    import __spark_entry__ as entry
    from compare import compare, duck

    assert compare(spark, duck(SF), queries[key], entry.oracle_sql()[key], SF) is None


def test_every_operator_is_registered(queries):
    assert [sum(k.startswith(f"op{n}_") for k in queries) for n in range(1, 14)] == [1] * 13 and "pipeline" in queries


def test_chat(spark, queries):
    marks = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for c, t, role, text in sorted(rows) + [(-7, 0, "user", marks), (-7, 1, "assistant", marks)]:
        by.setdefault(c, []).append((role, text or ""))
    got = {r["conv_id"]: r for r in queries["op2_chat_format"](spark, SF).collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        loss = "".join(t for r, t in own if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_repeats(spark, queries, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries["op3_suffix_dedup"](spark, SF).collect()}
    assert [got[i] for i, _, _ in docs] == brute_removed([t for _, t, _ in docs], 200)


def test_counts_and_files(spark, queries, docs):
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries["op5_token_counts"](spark, SF).collect()}
    files = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries["op10_token_files"](spark, SF).collect()}
    start = 0
    for i, text, _ in docs:
        n = len(library(BYTE, text))
        assert counts[i] == (len((text or "").encode()), n, n > 512)
        ids = library(WORD, text) + [1]
        assert files[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_mix(spark, queries, docs):
    sizes, taken, target = Counter(), Counter(), {}
    source = {i: s for i, _, s in docs}
    for r in queries["op6_mix_sources"](spark, SF).collect():
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    assert all(target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.05 * t + 20 for s, t in want.items())


def test_components(spark, queries, docs):
    got = sorted((tuple(r) for r in queries["op7_jaccard_join"](spark, SF).collect()), key=str)
    assert got == brute_components([(i, t) for i, t, _ in docs], 3, (90, 100))


def test_neighbours_reach_the_recall(spark, queries):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    asked = {i for i, _ in rows if i % 50 == 0}
    want = {(q, i) for q, _, i in brute_nearest(rows, asked, 5)}
    got = {(r["query_id"], r["vec_id"]) for r in queries["op9_nearest_neighbours"](spark, SF).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_simhash(spark, queries, docs):
    from test_simhash import brute

    got = sorted((tuple(r) for r in queries["op12_simhash"](spark, SF).collect()), key=str)
    assert got == brute([(i, t) for i, t, _ in docs])


def test_whitening(spark, queries):
    from test_whitening import check

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries["op11_whitening"](spark, SF).collect(), rows)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p
    from linkops.llm.common import materialize

    before = spark.read.parquet(f"{SF}/documents.parquet")
    stages, seen = dict(p.STAGES), {}
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token files"]
    frames = {}
    for name, stage in p.STAGES:
        out = materialize(stage(spark, before, SF), "stage")
        if name != "token files":
            assert out.columns == before.columns and dict(out.dtypes) == dict(before.dtypes)
        frames[name], before = out, out
        seen[name] = out.collect()
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality classifier"]}
    assert sum(i not in kept for i, q in good.items() if q == 1) <= 1
    rows = [(r["doc_id"], r["text"]) for r in seen["quality classifier"]]
    first = {i for i, _, c in brute_components(rows, 5, (80, 100)) if i == c}
    assert {r["doc_id"] for r in seen["n-gram Jaccard join"]} == first
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in seen["n-gram Jaccard join"] if not brute_hits(r["text"], items)[1]}
    assert {r["doc_id"] for r in seen["benchmark decontamination"]} == clean
    copies = Counter(r["doc_id"] for r in seen["mixing sources"])
    assert set(copies) <= clean and max(copies.values()) <= 3
    want, start = [], 0
    for r in sorted(seen["mixing sources"], key=lambda r: r["doc_id"]):
        ids = library(WORD, r["text"]) + [1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in seen["token files"]) == sorted(want)
