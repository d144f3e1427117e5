"""A corpus pipeline of five stages over ``documents``; every stage is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkops.llm.catalog import tokenizer_path
from linkops.llm.common import materialize, table
from linkops.llm.decontam import decontaminate
from linkops.llm.jaccard import one_per_component
from linkops.llm.mixing import mix
from linkops.llm.quality import quality
from linkops.llm.token_files import token_digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject.

    Null, empty and blank texts, null languages, and languages without a model have no perplexity or no threshold and
    stay; so do repeated rows and rows with a null id. Whole texts are scored, however long. An empty table stays empty.
    Columns beside those of ``documents`` are left out, here and in the stages below, whatever their names.
    """
    return quality(docs, table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8 or more.

    The row of the smallest id stays; rows that repeat it stay with it, so do rows with a null id, and null, empty and
    blank texts, which have no shingles. A shorter text is one shingle. An empty table stays empty.
    """
    return one_per_component(docs, width=5, threshold=(80, 100)).select(COLUMNS)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts have no words and stay. Rows that repeat each other go or stay together, null ids are like
    others, and an empty benchmark or an empty table leaves everything as it is.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own. Texts without words have the size 0. Repeated rows are documents of their own;
    a row that the mix takes twice stands there twice. An empty table stays empty.
    """
    return mix(docs).select(COLUMNS)


def token_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and the documents read back from them.

    Null and empty texts have the end id only. Repeated rows and rows that the mix took more than once are written each
    time, in the order of their ids, null first. An empty table gives no rows.
    """
    return token_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("mixing sources", mixed),
    ("token files", token_table),
]
# Language models, components and rounding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
