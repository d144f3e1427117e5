"""Token counts by a two-tier piece lookup on the map side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches
from .pretokens import splitter, worker_pieces

# The shared table is a cache: these bounds change the speed, never a count.
SAMPLE_DOCS = 2_000
SHARED_PIECES = 65_536


def shared_lengths(docs: DataFrame, tokenizer: str, text: str = "text", sample_docs: int = SAMPLE_DOCS,
                   size: int = SHARED_PIECES) -> dict[str, int]:
    """Token counts of frequent pieces, at most ``size``. Partitions are read one after the other, each for at most
    ``sample_docs`` texts, until there are enough pieces: one short task on all but small tables, and no shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, seen, n = splitter(tokenizer), Counter(), 0
        for batch in batches:
            for value in batch["t"]:
                seen.update(cut.cut(value) or ())
            n += len(batch)
            if n >= sample_docs:
                break
        top = [(p, len(cut.ids(p))) for p, _ in seen.most_common(size)]
        yield pd.DataFrame(top, columns=["piece", "n"])

    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    return dict(map(tuple, texts.mapInPandas(count, "piece string, n long").take(size)))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens",
                 sample_docs: int = SAMPLE_DOCS, size: int = SHARED_PIECES) -> DataFrame:
    """``docs`` with the number of tokens of ``text`` under the tokenizers file at ``tokenizer``.

    Nothing is shuffled: a broadcast table has the lengths of frequent pieces, and a worker encodes any other piece
    once and remembers it. Special strings inside a text count as the library counts them. Null or empty text: 0.
    Rows, their order and other columns stay; a column named like ``out`` is replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(shared_lengths(docs, tokenizer, text, sample_docs, size))

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = splitter(tokenizer)
        length = worker_pieces((tokenizer, "length"), lambda piece: len(cut.ids(piece)), shared.value).__getitem__
        for batch in texts:
            counts = []
            for value in batch:
                pieces = cut.cut(value)
                counts.append(len(cut.ids(value)) if pieces is None else sum(map(length, pieces)))
            yield pd.Series(counts, dtype="int64")

    (name,) = fresh(docs.drop(out), out)
    return docs.drop(out).withColumn(name, tokens(F.coalesce(F.col(text), F.lit(""))))
