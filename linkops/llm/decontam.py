"""Benchmark decontamination: a broadcast hash set of test n-grams against all word windows of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staged
from .common import ascii_lower, fresh, materialize, render

N = 10
# A broadcast holds at most this many windows; a larger benchmark is scanned for in blocks of this size.
BLOCK_WINDOWS = 250_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def benchmark_windows(benchmark: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """Stored windows (``len, hash, words, classes, block``) and stored classes of equal items (``class, items``).

    A window is ``n`` consecutive words; an item with fewer words is one window, an item without words has none.
    Equal items share a class, so copies of an item do not multiply anything; a null item id is written as ''.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    classes = items.where(F.size("w") > 0).groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "benchmark-items")
    length = F.least(F.size("w"), F.lit(n))
    cut = classes.select("class", "w", F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"), length.alias("len"))
    window = cut.select("class", "len", F.slice("w", F.col("at"), F.col("len")).alias("part"))
    grams = window.groupBy("len", "part").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    grams = materialize(grams.select("len", F.array_join("part", " ").alias("words"), "classes", "part"), "benchmark-grams")
    blocks = max(1, -(-grams.count() // BLOCK_WINDOWS))
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n values
    hashed = [grams.where(F.col("len") == k).select(
        "len", _window_hash([F.get("part", F.lit(j)) for j in range(k)]).alias("hash"), "words", "classes",
    ) for k in lengths]
    out = hashed[0] if hashed else grams.select("len", F.lit(0).cast("long").alias("hash"), "words", "classes")
    for more in hashed[1:]:
        out = out.unionByName(more)
    out = out.withColumn("block", F.pmod("hash", F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0))
    return materialize(out, "benchmark-windows"), classes


def _window_hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


@staged
def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per distinct ``doc_id`` and text: ``doc_id, text_key, n_words, hits, n_hit, items``.

    ``hits`` has the place and length in words of every benchmark window in the text, ``n_hit`` the number of words
    inside any of them, ``items`` the ids of the items with such windows, sorted. Every word window of every text is
    looked up by hash in the broadcast set, and a hit is compared word by word. Only rows with hits, and one row per
    document, leave the map side. Null and empty texts have no words; null ids are values; an empty benchmark gives
    no hits. Other columns of either table are not looked at.
    """
    grams, classes = benchmark_windows(benchmark, n)
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("w"))
    at = base.select("doc_id", "text_key", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "first"))
    blocks = grams.agg(F.max("block").alias("b"), F.collect_set("len").alias("k")).first()
    found = None
    for block in range((blocks["b"] or 0) + 1):
        for length in sorted(blocks["k"]) or [n]:
            part = grams.where((F.col("block") == block) & (F.col("len") == length))
            part = F.broadcast(part.select("hash", "words", "len", "classes"))  # at most BLOCK_WINDOWS rows
            own = _window_hash([F.col("first"), *[F.get("w", F.col("pos") + j) for j in range(1, length)]])
            same = (F.col("own") == F.col("hash")) & (F.array_join(F.slice("w", F.col("pos") + 1, F.lit(length)), " ") == F.col("words"))
            hit = at.withColumn("own", own).join(part, same, "left")
            hit = hit.where(F.col("hash").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
            hit = hit.select("doc_id", "text_key", "n_words", F.when(F.col("hash").isNotNull(), F.struct("pos", "len")).alias("place"), "classes")
            found = hit if found is None else found.unionByName(hit)
    rows = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set("place")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"),
    )
    rows = materialize(rows, "contamination")
    hit = rows.where(F.size("classes") > 0).select("doc_id", "text_key", F.explode("classes").alias("class"))
    named = hit.join(small_side(classes.select("class", "items")), "class").groupBy("doc_id", "text_key").agg(
        F.sort_array(F.flatten(F.collect_list("items"))).alias("items")
    ).toDF("hit_id", "hit_key", "items")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    return rows.join(named, same, "left").select(
        "doc_id", "text_key", "n_words", "hits", covered(F.col("hits")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(hits: Column) -> Column:
    """Number of places inside any of the sorted ``pos, len`` spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, hit: Column) -> Column:
        end = hit["pos"] + hit["len"]
        fresh_words = F.greatest(F.lit(0), end - F.greatest(acc["end"], hit["pos"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh_words).alias("n"))

    return F.aggregate(hits, start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, mode: str = "document") -> DataFrame:
    """``docs`` without contaminated documents (``document``), or without their hit words and the text before each
    (``span``). Columns and other rows stay as they are; null texts stay null."""
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    hid, hkey, hits = fresh(docs, "_hit_id", "_hit_key", "_hits")
    found = contamination(docs, benchmark, n).where(F.col("n_hit") > 0).select("doc_id", "text_key", "hits").toDF(hid, hkey, hits)
    same = docs["doc_id"].eqNullSafe(F.col(hid)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(hkey))
    found = small_side(materialize(found, "contaminated"), 100_000)
    if mode == "document":
        return docs.join(found, same, "left_anti")
    # A piece is a word with the gap before it; the last piece may be a gap alone.
    gap, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({gap}*{word}+|{gap}+)"), 1)
    inside = lambda i: F.exists(F.col(hits), lambda h: (i >= h["pos"]) & (i < h["pos"] + h["len"]))
    kept = F.array_join(F.filter(pieces, lambda _, i: ~inside(i)), "")
    joined = docs.join(found, same, "left")
    return joined.withColumn("text", F.when(F.col(hits).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def sql(n: int = N) -> str:
    """Contamination of ``documents`` by ``benchmark`` in DuckDB's SQL."""
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return render(r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {cut} AS w FROM benchmark), bl AS (SELECT item, w, least(len(w), {n}) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM bl)),
d AS (SELECT doc_id, {cut} AS w FROM documents), ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, p.k, item FROM p JOIN g ON p.k = g.k AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""", cut=cut, n=n)
