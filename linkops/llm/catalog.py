"""Queries of the corpus operators over the driver tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lexical, licences
from .common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(key: str, sql: str | None = None):
    def register(fn):
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn

    return register


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op5_token_counts")
def token_counts(spark, sf_dir):
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


@_query("op10_token_files")
def token_files(spark, sf_dir):
    from .token_files import token_digests

    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query("op2_chat_format")
def chat_format(spark, sf_dir):
    from .chat import format_windows, read_windows
    from .common import materialize

    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    windows = materialize(format_windows(turns, tokenizer_path("byte_bpe_50k.json")), "chat-windows")
    return read_windows(windows)


@_query("op4_licence_scan", licences.sql())
def licence_scan(spark, sf_dir):
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"),
    )


@_query("op6_mix_sources")
def mix_sources(spark, sf_dir):
    from .mixing import plan_mix

    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@_query("op1_decontamination", decontam.sql())
def decontamination(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op9_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    from .neighbours import nearest

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


@_query("op8_quality_classifier")
def quality_classifier(spark, sf_dir):
    from .quality import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "lang", F.char_length("text").cast("long").alias("n_chars"), "perplexity", "threshold", "kept")


@_query("op7_jaccard_join")
def jaccard_join(spark, sf_dir):
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op3_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    from .suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True)


@_query("op11_whitening")
def whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_query("op12_simhash")
def simhash(spark, sf_dir):
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op13_lexical_search", lexical.sql())
def lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
