"""Quality classifier: an interpolated modified Kneser-Ney character model of trusted text, per language.

An n-gram is packed into one integer, ``CHAR_BITS`` for each character, oldest character highest; so a context is a
shift and a shorter n-gram a mask. Character ``UNKNOWN`` stands for all characters that trusted text does not have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staging
from .common import fresh, materialize, scratch_path, small_batches
from .pretokens import forget

ORDER = 4
CHAR_BITS = 15
UNKNOWN, START, FIRST = 0, 1, 2
# A model with at most this many entries is sent to all tasks; a larger one is joined shard by shard.
BROADCAST_ENTRIES = 2_000_000
# Characters at the mean of the language that every document is taken to have besides its own.
PRIOR_CHARS = 100
# A document is rejected above this quantile of held-out trusted documents of its language.
LEVEL = 0.999
HELD_OUT = 5
CHUNK_CHARS = 200_000
LEAST_HELD_OUT = 5


class Alphabet:
    """Code points to small numbers."""

    def __init__(self, points: list[int]):
        self.points = np.array(sorted(points), np.uint32)
        self._codes: np.ndarray | None = None

    def __getstate__(self):
        return {"points": self.points, "_codes": None}

    def codes(self, text: str) -> np.ndarray:
        if self._codes is None:
            self._codes = np.full(0x110000, UNKNOWN, np.uint16)
            self._codes[self.points] = np.arange(len(self.points)) + FIRST
        return self._codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def grams(self, texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram ending in each character of all texts, and where each text begins; texts begin with start marks."""
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(texts) + 1) * (order - 1), size)
        codes = np.full(int(size.sum()) + len(texts) * (order - 1), START, np.int64)
        codes[place] = self.codes("".join(texts))
        out = np.zeros(len(place), np.int64)
        for k in range(order - 1, -1, -1):
            out = (out << CHAR_BITS) | codes[place - k]
        return out, first


def trusted_alphabet(trusted: DataFrame) -> Alphabet:
    """The most frequent characters of trusted text, as many as ``CHAR_BITS`` can name."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                found, n = np.unique(raw, return_counts=True)
                total[found] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"point": some, "n": total[some]})

    counts = trusted.select("text").mapInArrow(points, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "point").limit((1 << CHAR_BITS) - FIRST).toPandas()
    return Alphabet(top["point"].tolist())


def _compact(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_counts(trusted: DataFrame, alphabet: Alphabet, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over all trusted texts; each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, list] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum([len(t) for t in own]) // CHUNK_CHARS)) + 1):
                    grams, _ = alphabet.grams([own[i] for i in part], order)
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                if len(held[lang]) > 16:
                    held[lang] = [_compact(held[lang])]
        for lang, parts in held.items():
            keys, n = _compact(parts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys, "n": n})

    rows = trusted.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(counts: DataFrame, alphabet: Alphabet, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Probabilities ``lang, k, gram, p`` of seen n-grams of every length ``k`` and weights ``lang, k, context, w``.

    The longest n-grams have their counts, shorter ones the number of different characters before them. Counts,
    contexts and shorter probabilities meet in joins on (language, n-gram), so every shard holds a part of each.
    """
    mask = lambda k: F.lit((1 << CHAR_BITS * k) - 1)
    tables = {order: materialize(counts, "grams")}
    for k in range(order - 1, 0, -1):
        shorter = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask(k)).alias("gram"))
        tables[k] = materialize(shorter.agg(F.count(F.lit(1)).alias("n")), "grams")
    vocabulary = float(len(alphabet.points) + 1)
    probabilities, weights, below = [], [], None
    for k in range(1, order + 1):
        have = [F.sum((F.col("n") == i).cast("double")).alias(f"c{i}") for i in (1, 2, 3, 4)]
        y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
        cut = lambda i: F.when(F.col(f"c{i}") > 0, F.lit(float(i)) - (i + 1) * y * F.col(f"c{i + 1}") / F.col(f"c{i}"))
        # Where counts of counts are missing the usual half, one and one and a half serve.
        discounts = tables[k].groupBy("lang").agg(*have).select("lang", *[
            F.when((F.col("c1") > 0) & cut(i).between(0.0, float(i)), cut(i)).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)
        ])
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = tables[k].join(F.broadcast(discounts), "lang").select(  # one row per language
            "lang", "gram", F.shiftright("gram", CHAR_BITS).alias("context"), "n", discount.alias("d"),
        )
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("d").alias("off"))
        totals = materialize(totals.select("lang", "context", "all", (F.col("off") / F.col("all")).alias("w")), "contexts")
        own = rows.join(totals, ["lang", "context"])
        if below is None:
            lower = own.withColumn("lower", F.lit(1.0 / vocabulary))
        else:
            suffix = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            lower = own.withColumn("suffix", F.col("gram").bitwiseAND(mask(k - 1))).join(suffix, ["lang", "suffix"])
        p = (F.col("n") - F.col("d")) / F.col("all") + F.col("w") * F.col("lower")
        below = materialize(lower.select("lang", "gram", p.alias("p")), "probabilities")
        probabilities.append(below.withColumn("k", F.lit(k)))
        weights.append(totals.select("lang", "context", "w").withColumn("k", F.lit(k)))
    stack = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(stack(parts[1:]))
    return stack(probabilities), stack(weights)


class _Table:
    """Hash table from n-grams to numbers: arrays with open addressing, filled and searched many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] < 0
            slot, who = np.unique(at[free], return_index=True)  # the first of those that want a slot has it
            won = np.flatnonzero(free)[who]
            self.keys[slot], self.values[slot] = keys[left[won]], values[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (zero if not)."""
        at = self._home(keys)
        held = self.keys[at]
        seen, out = held == keys, self.values[at]
        open_ = np.flatnonzero(~seen & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            seen[open_[hit]] = True
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return seen, np.where(seen, out, 0.0)


class _Model:
    """Tables of one language and the probabilities of any n-grams by backing off."""

    def __init__(self, order: int, vocabulary: float):
        self.order, self.floor = order, 1.0 / vocabulary
        self.p: dict[int, _Table] = {}
        self.w: dict[int, _Table] = {}

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        out, scale, open_ = np.empty(len(grams)), np.ones(len(grams)), np.arange(len(grams))
        for k in range(self.order, 0, -1):
            here = grams[open_] & ((1 << CHAR_BITS * k) - 1)
            seen, p = self.p[k].find(here)
            out[open_[seen]] = scale[open_[seen]] * p[seen]
            open_, here = open_[~seen], here[~seen]
            if not len(open_):
                return out
            seen, w = self.w[k].find(here >> CHAR_BITS)
            scale[open_[seen]] *= w[seen]
        out[open_] = scale[open_] * self.floor
        return out


def _models(probabilities: DataFrame, weights: DataFrame, alphabet: Alphabet, order: int) -> dict[str, _Model]:
    """The model on the driver; it has at most ``BROADCAST_ENTRIES`` entries."""
    vocabulary, models = float(len(alphabet.points) + 1), {}
    langs = sorted(r["lang"] for r in probabilities.select("lang").distinct().collect())  # one per language
    for lang in langs:
        model = models[lang] = _Model(order, vocabulary)
        for k in range(1, order + 1):
            for frame, key, value, into in ((probabilities, "gram", "p", model.p), (weights, "context", "w", model.w)):
                held = frame.where((F.col("lang") == lang) & (F.col("k") == k)).select(key, value).toArrow()
                keys, values = (held.column(i).to_numpy() for i in (0, 1))
                into[k] = _Table(keys, values)
    return models


def _score_broadcast(docs: DataFrame, models: dict[str, _Model], alphabet: Alphabet, order: int, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((models, alphabet))

    @F.pandas_udf("double")
    def log_probability(texts: pd.Series, langs: pd.Series) -> pd.Series:
        models, alphabet = shared.value
        out = np.full(len(texts), np.nan)
        size, lang = texts.str.len().to_numpy(), langs.to_numpy()
        for name, model in models.items():
            rows = np.flatnonzero((lang == name) & (size > 0))
            # A few texts at a time: arrays of all n-grams of a batch would take most of a worker's memory.
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // CHUNK_CHARS)) + 1):
                if len(part):
                    grams, first = alphabet.grams(texts.iloc[part].tolist(), order)
                    out[part] = np.add.reduceat(np.log(model.probabilities(grams)), first)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    empty = F.lit("")
    return docs.withColumn(out, log_probability(F.coalesce("text", empty), F.coalesce("lang", empty)))


def resolve(grams: DataFrame, probabilities: DataFrame, weights: DataFrame, alphabet: Alphabet, order: int = ORDER) -> DataFrame:
    """``lang, gram`` with ``p`` for any n-grams, by joins with the seen ones and the weights of their contexts."""
    mask = lambda k: F.lit((1 << CHAR_BITS * k) - 1)
    out = grams.withColumns({"p": F.lit(None).cast("double"), "scale": F.lit(1.0)})
    for k in range(order, 0, -1):
        seen = probabilities.where(F.col("k") == k).select("lang", F.col("gram").alias("part"), F.col("p").alias("own"))
        back = weights.where(F.col("k") == k).select("lang", "context", "w")
        out = out.withColumn("part", F.col("gram").bitwiseAND(mask(k))).join(seen, ["lang", "part"], "left")
        out = out.withColumn("context", F.shiftright("part", CHAR_BITS)).join(back, ["lang", "context"], "left")
        out = out.select(
            "lang", "gram", F.coalesce("p", F.col("scale") * F.col("own")).alias("p"),
            (F.col("scale") * F.coalesce("w", F.lit(1.0))).alias("scale"),
        )
    return out.select("lang", "gram", F.coalesce("p", F.col("scale") / F.lit(float(len(alphabet.points) + 1))).alias("p"))


def _score_joined(docs: DataFrame, probabilities: DataFrame, weights: DataFrame, alphabet: Alphabet, order: int, out: str) -> DataFrame:
    """The same scores by joins: n-grams of every document, counted, meet their probability shard by shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                grams, n = np.unique(alphabet.grams([text], order)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": [key] * len(grams), "lang": [lang] * len(grams), "gram": grams, "n": n})

    key, mine, sum_key, sum_lang, sum_ = fresh(docs, "_text_key", "_text_lang", "_sum_key", "_sum_lang", "_sum")
    empty = F.lit("")
    keyed = docs.withColumns({key: F.xxhash64(F.coalesce("text", empty)), mine: F.coalesce("lang", empty)})
    texts = keyed.where(F.col("text") != "").select(F.col(key).alias("key"), F.col(mine).alias("lang"), "text").dropDuplicates(["key", "lang"])
    rows = materialize(texts.mapInArrow(count, "key long, lang string, gram long, n long"), "document-grams")
    known = probabilities.select("lang").distinct()
    needed = rows.select("lang", "gram").distinct().join(F.broadcast(known), "lang", "left_semi")  # one row per language
    p = resolve(needed, probabilities, weights, alphabet, order)
    sums = rows.join(p, ["lang", "gram"]).groupBy("key", "lang").agg(F.sum(F.col("n") * F.ln("p")).alias("sum"))
    sums = sums.toDF(sum_key, sum_lang, sum_)
    joined = keyed.join(sums, (F.col(key) == F.col(sum_key)) & (F.col(mine) == F.col(sum_lang)), "left")
    return joined.select(*docs.columns, F.col(sum_).alias(out))


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, level: float = LEVEL, prior: int = PRIOR_CHARS,
            most: int = BROADCAST_ENTRIES) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` and ``kept``.

    Trusted are all documents whose label says quality 1 and not toxic; four fifths of them (by a hash of the id)
    train a model per language, the rest give the quantile ``level`` that is its threshold. Perplexity is per character, with
    ``prior`` characters at the language's mean added, so that a short text is not rejected for one odd word.
    Documents without text, and languages with no model or fewer than five held-out documents, have no perplexity or
    no threshold and are kept. Null languages are one language. Rows, repeated ones too, and other columns stay;
    columns named like the outputs are replaced. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("perplexity", "threshold", "kept")
    total, limit_lang, limit_mean = fresh(base, "_log_p", "_limit_lang", "_limit_mean")
    smooth = lambda n, mean="mean": (-F.col(total) + F.col(mean) * prior) / (n + F.lit(prior))
    with staging(docs.sparkSession):
        score, limits = _fit(base, labels, order, total, smooth, level, most)
    limits = limits.toDF(limit_lang, limit_mean, "threshold")
    scored = score(base).join(F.broadcast(limits), F.coalesce(F.col("lang"), F.lit("")) == F.col(limit_lang), "left")
    scored = scored.withColumn("perplexity", F.exp(smooth(F.char_length("text"), limit_mean)))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return scored.withColumn("kept", kept).select(*base.columns, "perplexity", "threshold", "kept")


def _fit(base: DataFrame, labels: DataFrame, order: int, total: str, smooth, level: float, most: int):
    """The scorer of the trained model, and one row per language with its mean and threshold."""
    spark = base.sparkSession
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    known = base.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    trusted = known.join(small_side(good), "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    alphabet = trusted_alphabet(trusted)
    p, w = train(gram_counts(trusted.where(~held), alphabet, order), alphabet, order)
    if p.count() + w.count() <= most:
        models = _models(p, w, alphabet, order)
        score = lambda rows: _score_broadcast(rows, models, alphabet, order, total)
    else:
        p, w = (_kept(x) for x in (p, w))
        score = lambda rows: _score_joined(rows, p, w, alphabet, order, total)
    rest = materialize(score(trusted.where(held)).where(F.col(total).isNotNull()).select("lang", F.char_length("text").alias("n"), total), "held-out")
    means = rest.groupBy("lang").agg((-F.sum(total) / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("docs"))
    value = smooth(F.col("n"))
    found = rest.join(F.broadcast(means), "lang").groupBy("lang", "mean", "docs").agg(  # one row per language
        F.percentile_approx(value, level, 10_000).alias("quantile"), F.avg(value).alias("centre"), F.stddev_samp(value).alias("width")
    )
    rows = [(r["lang"], r["mean"], _threshold(r, level)) for r in found.collect()]  # one row per language
    return score, spark.createDataFrame(rows, "lang string, mean double, threshold double")


def _threshold(held, level: float) -> float | None:
    """Perplexity that a trusted document stays below with probability ``level``: the quantile of the held-out ones.

    Too few documents to have that quantile give their largest value instead, which more than one in ``1 / (1 - level)``
    trusted documents exceed. There the bound of one more normal value, by Student's t, serves if it is higher.
    """
    if held["docs"] < LEAST_HELD_OUT:
        return None
    limit, docs = held["quantile"], held["docs"]
    if docs * (1 - level) < 1:
        limit = max(limit, held["centre"] + _student(level, docs - 1) * held["width"] * math.sqrt(1 + 1 / docs))
    return math.exp(limit)


def _student(level: float, freedom: int) -> float:
    """Quantile of Student's t from that of the normal distribution (Cornish and Fisher's series)."""
    z = NormalDist().inv_cdf(level)
    terms = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + sum(term / freedom**i for i, term in enumerate(terms, 1))


def _kept(df: DataFrame) -> DataFrame:
    """Stored for as long as the result is of use."""
    path = scratch_path(df.sparkSession, "language-model")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
