"""MCS decisions over candidate arrays, and the tables that compare them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, col, floor_bin, linspace, weighted_mean
from ..functions.radio import cqi_to_mcs
from .candidates import matrix
from .evaluate import thresholds_met

FALLBACKS = ("min_zero", "argmax_p", "min_p", "first")


def _argmax(cand, score, keep=None) -> Column:
    """Candidate with the largest score, first (lowest MCS) among equals; null when none is kept.

    One fold over the array that returns the candidate itself, so nothing is evaluated twice.
    """
    none = F.try_element_at(cand, F.lit(0x7FFFFFFF))

    def better(best, x):
        wins = best["mcs"].isNull() | (score(x) > score(best))
        return F.when(wins if keep is None else (keep(x) & wins), x).otherwise(best)

    return F.aggregate(cand, none, better)


def _array(cand) -> Column:
    return F.col(cand) if isinstance(cand, str) else cand


def _highest(cand, tau) -> Column:
    """Highest candidate with p >= tau, or null."""
    return F.aggregate(cand, F.try_element_at(cand, F.lit(0x7FFFFFFF)), lambda best, x: F.when(x["p"] >= tau, x).otherwise(best))


def _first(cand, zero_p: bool = False) -> Column:
    head = F.element_at(cand, 1)
    if not zero_p:
        return head
    return F.struct(head["mcs"].alias("mcs"), F.lit(0.0).alias("p"), head["eff"].alias("eff"))


def _fallback(cand, fallback: str) -> Column:
    return best_probability(cand) if fallback == "argmax_p" else _first(cand, fallback == "min_zero")


def _score(x) -> Column:
    return x["p"] * x["eff"]


def best_probability(cand="cand") -> Column:
    return _argmax(_array(cand), lambda x: x["p"])


def threshold_choice(tau, cand="cand", fallback: str = "argmax_p") -> Column:
    """Highest MCS with p >= tau. Without one: ``argmax_p``, ``min_p``/``first``, or ``min_zero`` (p reported 0)."""
    if fallback not in FALLBACKS:
        raise ValueError(f"unknown fallback {fallback!r}")
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    return F.coalesce(_highest(_array(cand), tau), _fallback(_array(cand), fallback))


def throughput_choice(cand="cand") -> Column:
    """Largest p x efficiency; ties and an all-zero row give the lowest MCS."""
    return _argmax(_array(cand), _score)


def best_throughput(cand="cand") -> Column:
    """:func:`throughput_choice` in Arrow batches, for choices made once in each row."""
    return F.arrow_udf(_best_throughput, "struct<mcs:int,p:double,eff:double>")(_array(cand))


def _best_throughput(cand: pa.Array) -> pa.Array:
    p, inside = matrix(cand, "p")
    if not inside.size:
        return pa.nulls(len(cand), cand.type.value_type)
    flat = cand.flatten()
    missing = np.ones(inside.shape, bool)
    missing[inside] = flat.field("p").is_null().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        score = np.where(missing, -np.inf, p * matrix(cand, "eff")[0])  # NaN is larger than all numbers
    pick = np.where(missing[:, 0], 0, score.argmax(axis=1))  # nothing is larger than a first one that is null
    lengths = inside.sum(axis=1)
    return flat.take(pa.array(np.cumsum(lengths) - lengths + pick, pa.int64(), mask=lengths == 0))


def constrained_choice(tau, cand="cand", fallback: str = "argmax_p") -> Column:
    """Largest p x efficiency among p >= tau; otherwise the fallback."""
    best = _argmax(_array(cand), _score, lambda x: x["p"] >= F.lit(tau))
    return F.coalesce(best, _fallback(_array(cand), fallback))


def guardrailed_choice(guardrail=None, cand="cand") -> Column:
    """Largest p x efficiency with p >= guardrail; the lowest MCS if none qualifies."""
    return throughput_choice(cand) if guardrail is None else constrained_choice(guardrail, cand, "first")


def fixed_choice(mcs, cand="cand") -> Column:
    """The candidate with the given MCS; null when it is not a candidate. Candidates are consecutive."""
    array = _array(cand)
    at = mcs - F.element_at(array, 1)["mcs"] + 1
    return F.when((at >= 1) & (at <= F.size(array)), F.try_element_at(array, at))


def guarded_mcs(baseline, guardrail=None, cand="cand") -> Column:
    """Baseline MCS, replaced by the highest MCS with p >= guardrail whenever one exists (up or down)."""
    if guardrail is None or guardrail < 0:
        return col(baseline)
    return F.coalesce(_highest(_array(cand), F.lit(guardrail))["mcs"], col(baseline))


def cqi_choice(cqi="cqi", guardrail=None, cand="cand", offset: int = 0, **mapping) -> Column:
    """CQI baseline with its probability, null without a CQI; ``mapping`` goes to :func:`linkops.functions.radio.cqi_to_mcs`."""
    low, high = mapping.get("mcs_min", 0), mapping.get("mcs_max", 27)
    mapped = F.when(col(cqi).isNotNull(), clip(cqi_to_mcs(cqi, **mapping) + F.lit(offset), low, high))
    return _lookup(guarded_mcs(mapped, guardrail, cand), cand)


def _lookup(mcs, cand) -> Column:
    """:func:`fixed_choice` with the index bound once."""
    return F.element_at(F.transform(F.array(mcs), lambda m: fixed_choice(m, cand)), 1)


def lut_choice(mcs, guardrail=None, cand="cand", mcs_min: int = 0, mcs_max: int = 27) -> Column:
    clamped = clip(col(mcs).cast("int"), mcs_min, mcs_max)
    return _lookup(guarded_mcs(clamped, guardrail, cand), cand)


def recommend(df: DataFrame, objective: str = "threshold", tau: float = 0.5, guardrail: float | None = None,
              fallback: str = "min_zero", cand: str = "cand") -> DataFrame:
    """Recommendation columns ``rec_mcs, rec_prob, rec_eff, rec_expected`` for a frame with candidates."""
    choices = {
        "threshold": lambda: threshold_choice(tau, cand, fallback),
        "throughput": lambda: throughput_choice(cand),
        "constrained": lambda: constrained_choice(tau, cand),
        "guardrail": lambda: guardrailed_choice(guardrail, cand),
    }
    picked = df.withColumn("_pick", choices[objective]())
    return picked.select(
        *[c for c in df.columns if c != cand],
        F.col("_pick.mcs").alias("rec_mcs"), F.col("_pick.p").alias("rec_prob"), F.col("_pick.eff").alias("rec_eff"),
        (F.col("_pick.p") * F.col("_pick.eff")).alias("rec_expected"),
    )


def stack(df: DataFrame, choices: dict[str, Column], keep=()) -> DataFrame:
    """One row per input row and policy: ``policy, mcs, p, eff`` plus ``keep``."""
    entries = F.array(*[F.struct(F.lit(name).alias("policy"), c.alias("pick")) for name, c in choices.items()])
    return df.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.policy", "_e.pick.*")


def policy_summary(stacked: DataFrame, draw: Column | None = None, keys=(), weight: str | None = None) -> DataFrame:
    """Accept rate, violation, expected and realised throughput and mean MCS per policy.

    ``draw`` is a uniform column; when given, realised throughput counts sampled successes. With ``weight`` a row
    stands for so many equal ones.
    """
    score = F.col("p") * F.col("eff")
    realised = score if draw is None else F.when(draw < F.col("p"), F.col("eff")).otherwise(0.0)
    return stacked.groupBy(*keys, "policy").agg(
        F.lit(1.0).alias("accept_rate"),
        (1 - weighted_mean("p", weight)).alias("violation"),
        weighted_mean(score, weight).alias("throughput_expected"),
        weighted_mean(realised, weight).alias("throughput_realized"),
        weighted_mean("mcs", weight).alias("avg_mcs"),
    )


def elevation_series(stacked: DataFrame, elevation: str = "ele_angle", width: float = 1.0,
                     weight: str | None = None) -> DataFrame:
    """Mean error probability and MCS per elevation bin and policy."""
    return stacked.groupBy(floor_bin(elevation, width).alias("ele_bin"), "policy").agg(
        weighted_mean(1 - F.col("p"), weight).alias("bler"), weighted_mean("mcs", weight).alias("mcs"),
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("rows"),
    )


def sweep_taus(grid: int = 25) -> list[float]:
    return linspace(0.1, 0.95, max(5, grid))


def acceptance_sweep(df: DataFrame, taus, cand: str = "cand", weight: str | None = None) -> DataFrame:
    """Accept rate, reliability and throughput of the threshold policy for every tau, from one pass.

    A candidate is the choice exactly for the taus above every later probability and up to its own. Rows are
    summed per such span of taus (a few hundred spans at most); spans are spread over the taus afterwards.
    ``taus`` are evenly spaced. With ``weight`` a row stands for so many equal ones.
    """
    taus = sorted(float(t) for t in taus)
    empty = F.array().cast("array<struct<above:int,upto:int,p:double,score:double>>")

    def step(acc, x):
        # From the highest MCS down: a candidate adds the taus that no later one met.
        met = thresholds_met(x["p"], taus)
        span = F.struct(acc["top"].alias("above"), met.alias("upto"), x["p"].alias("p"), _score(x).alias("score"))
        return F.when(
            met > acc["top"], F.struct(met.alias("top"), F.concat(acc["spans"], F.array(span)).alias("spans"))
        ).otherwise(acc)

    start = F.struct(F.lit(0).alias("top"), empty.alias("spans"))
    spans = F.aggregate(F.reverse(cand), start, step, lambda acc: acc["spans"])
    times = F.col(weight) if weight else F.lit(1).cast("bigint")
    rows = df.select(times.alias("w"), F.explode(spans).alias("s"))
    by_span = rows.groupBy(F.col("s.above").alias("above"), F.col("s.upto").alias("upto")).agg(
        F.sum("w").alias("n"), F.sum(F.col("s.p") * F.col("w")).alias("p"), F.sum(F.col("s.score") * F.col("w")).alias("score")
    )
    sums = by_span.withColumn("i", F.explode(F.sequence(F.col("above") + 1, F.col("upto")))).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("score").alias("score")
    )
    total = df.agg(F.coalesce(F.sum(times), F.lit(0)).alias("total"))
    grid = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(taus, start=1)], "i int, tau double")
    out = F.broadcast(grid).join(F.broadcast(total)).join(sums, "i", "left").na.fill(0, ["n"])
    accept = F.col("n") / F.col("total")
    mean_score = F.coalesce(F.try_divide(F.col("score"), F.col("n")), F.lit(0.0))
    return out.select(
        "tau", accept.alias("accept_rate"),
        F.coalesce(F.try_divide(F.col("p"), F.col("n")), F.lit(0.0)).alias("reliability_acc"),
        mean_score.alias("tput_acc"), (accept * mean_score).alias("tput_agg"),
    )


def pareto(df: DataFrame, taus, cand: str = "cand", weight: str | None = None) -> DataFrame:
    """Sweep rows plus one row (null tau) with the point of the throughput policy."""
    sweep = acceptance_sweep(df, taus, cand, weight)
    point = df.select(throughput_choice(cand).alias("c"), *[weight for _ in range(bool(weight))]).agg(
        F.lit(1.0).alias("accept_rate"), weighted_mean("c.p", weight).alias("reliability_acc"),
        weighted_mean(F.col("c.p") * F.col("c.eff"), weight).alias("tput_acc"),
    ).select(
        F.lit("throughput").alias("series"), F.lit(None).cast("double").alias("tau"), "accept_rate",
        "reliability_acc", "tput_acc", F.col("tput_acc").alias("tput_agg"),
    )
    return sweep.select(F.lit("threshold").alias("series"), *sweep.columns).unionByName(point)


def guardrail_by_elevation(df: DataFrame, targets=(0.001, 0.01, 0.05, 0.10), elevation: str = "ele_angle",
                           width: float = 1.0, cand: str = "cand", own_target: str | None = None) -> DataFrame:
    """Error probability and MCS per elevation bin for the guardrails tau = 1 - target.

    With ``own_target`` each row uses the target in that column (for example from its file name) instead of
    the list.
    """
    if own_target is not None:
        picked = df.select(
            elevation, F.col(own_target).alias("target"),
            threshold_choice(1 - F.col(own_target), cand, "min_p").alias("pick"),
        )
    else:
        entries = F.array(*[
            F.struct(F.lit(float(t)).alias("target"), threshold_choice(1.0 - float(t), cand, "min_p").alias("pick"))
            for t in targets
        ])
        picked = df.select(elevation, F.explode(entries).alias("_e")).select(elevation, "_e.*")
    return picked.groupBy(floor_bin(elevation, width).alias("ele_bin"), "target").agg(
        F.avg(1 - F.col("pick.p")).alias("bler_avg"), F.avg("pick.mcs").alias("mcs_avg")
    )


def what_if(df: DataFrame, mcs_values, tau: float, cand: str = "cand") -> DataFrame:
    """Selected MCS of each context with probability, efficiency and the pass flag."""
    wanted = F.filter(F.col(cand), lambda x: x["mcs"].isin(*mcs_values))
    rows = df.withColumn("_c", F.explode(wanted)).drop(cand, *[c for c in ("mcs", "p", "eff") if c in df.columns])
    return rows.select("*", "_c.*").drop("_c").withColumn("passes", F.col("p") >= F.lit(tau))
