"""Token counts, token files and chat windows against the library and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "Hello world's  end\n\n\tx", "naïve Ærø — “quoted” ½ ²", "日本語 text 한국어", "a<|endoftext|>b", "İstanbul ſ ŉ",
    " x\u0085y\x1cz", "same text", "same text", "word " * 30_000, "'ll 've'S 1234 $$$###",
]


def library(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")


def test_counts_equal_the_library(docs):
    from linkops.llm.token_counts import count_tokens

    got = count_tokens(docs, BYTE, out="n_tokens").collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(library(BYTE, t)) for t in TEXTS)
    small = count_tokens(docs, BYTE, out="n", sample_docs=1, size=2)
    assert sorted(r["n"] for r in small.collect()) == sorted(len(library(BYTE, t)) for t in TEXTS)
    assert count_tokens(docs.limit(0), BYTE).count() == 0


def test_random_texts_split_like_the_library():
    from linkops.llm.pretokens import splitter

    pick, signs = random.Random(3), [chr(c) for c in (*range(32, 127), 9, 10, 13, 0xA0, 0xDF, 0xE9, 0x130, 0x17F, 0x300, 0x4E00)] + ["'ll", "  "]
    for path in (BYTE, WORD):
        cut = splitter(path)
        for _ in range(2000):
            text = "".join(pick.choice(signs) for _ in range(pick.randint(0, 20)))
            pieces = cut.cut(text)
            assert pieces is None or [i for p in pieces for i in cut.ids(p)] == cut.ids(text)


def test_piece_cache_starts_anew_when_full():
    from linkops.llm.pretokens import Pieces

    cache = Pieces(len, {"ab": 2}, limit=2)
    assert [cache[x] for x in ("ab", "a", "abc", "abcd", "ab")] == [2, 1, 3, 4, 2] and len(cache) <= 3


def test_files_hold_all_ids_in_order(spark, docs, tmp_path):
    from linkops.llm.token_files import read_token_files, sequence, write_token_files

    manifest = write_token_files(docs, WORD, f"file://{tmp_path}/t", end_id=1, length=64, per_batch=3)
    got = [tuple(r) for r in read_token_files(manifest).orderBy("start").collect()]
    rows = sorted(((i if i % 5 else None, t or "") for i, t in enumerate(TEXTS)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, want, all_ids = 0, [], []
    for i, t in rows:
        ids = library(WORD, t) + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        all_ids += ids
    assert got == want
    seen = []
    for shard in manifest.orderBy("shard").collect():
        for k in range(-(-shard["tokens"] // 64)):
            one = sequence(shard["path"], k)
            assert len(one["input_ids"]) == 64
            seen += one["input_ids"][one["attention_mask"]].tolist()
    assert seen == all_ids
    assert read_token_files(write_token_files(docs.limit(0), WORD, f"{tmp_path}/e")).count() == 0


def test_chat_windows_round_trip(spark):
    from linkops.llm.chat import format_windows, parse, read_windows

    marks = "</s>[INST] ok [/INST]<|im_end|>\n<|im_start|>user\n\\ \\\\ <\\s>"
    rows = [(1, 0, "system", "be brief"), *[(1, t, ("user", "assistant")[t % 2], f"turn {t} " + "word " * 40) for t in range(1, 40)]]
    rows += [(2, 0, "user", marks), (2, 1, "assistant", marks), (3, 0, None, None), (3, 0, None, None), (None, None, "assistant", "x"),
             (4, 0, "odd\nrole\\n", ""), (5, 1, "assistant", "big " * 5000), (5, 0, "system", "s"), (6, 0, "system", "only")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, WINDOW int")
    windows = format_windows(turns, BYTE, budget=200, history=2).cache()
    got = {r["conv_id"]: r for r in read_windows(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        turns_in = list(parse(w["formatted"]))
        assert len(turns_in) == w["context_turns"] + w["new_turns"]
        assert w["tokens"] <= 200 or w["new_turns"] == 1 or (w["window"] == 0 and w["new_turns"] == 2)
        if w["conv_id"] == 1:
            assert turns_in[0][:2] == ("system", "be brief") and w["context_turns"] <= 3
        if w["conv_id"] == 2:
            assert all(m not in w["formatted"][a:b] for _, _, a, b in turns_in for m in ("</s>", "[INST]", "<|im_end|>"))
    assert read_windows(format_windows(turns.limit(0), BYTE)).count() == 0
