"""Candidate MCS per row.

The candidates of a row travel with it as one array of ``(mcs, p, eff)``, at most 28 entries in MCS order. A
choice among them is then a column expression: no row is multiplied and nothing is shuffled. The long form
exists for scorers that work on rows, such as fitted models.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.radio import MCS_MAX, MCS_MIN, efficiency, efficiency_column


def candidates(df: DataFrame, probability: Callable[[Column], Column], mcs_min: int = MCS_MIN,
               mcs_max: int = MCS_MAX, out: str = "cand", unrolled: bool = False) -> DataFrame:
    """Array of candidates from a closed-form pass probability of (row, MCS).

    One lambda over a constant array: unrolled, 28 structs would outgrow what the JVM compiles as part of a whole stage.
    ``unrolled`` is for arrays that one Arrow function takes: its arguments are compiled piece by piece, which takes a
    quarter of the lambda's time.
    """
    if unrolled:
        return df.withColumn(out, F.array(*[
            F.struct(F.lit(m).alias("mcs"), probability(F.lit(m)).cast("double").alias("p"), F.lit(efficiency(m)).alias("eff"))
            for m in range(mcs_min, mcs_max + 1)
        ]))
    table = F.array(*[
        F.struct(F.lit(m).alias("mcs"), F.lit(efficiency(m)).alias("eff")) for m in range(mcs_min, mcs_max + 1)
    ])
    return df.withColumn(out, F.transform(table, lambda x: F.struct(
        x["mcs"].alias("mcs"), probability(x["mcs"]).cast("double").alias("p"), x["eff"].alias("eff")
    )))


def matrix(cand: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a candidate field as doubles, a line for each row, and which of them are candidates. Nulls and places
    behind a shorter array are NaN; a null array has no candidates."""
    lengths = pc.fill_null(pc.list_value_length(cand), 0).to_numpy(zero_copy_only=False)
    values = pc.cast(cand.flatten().field(field), pa.float64()).to_numpy(zero_copy_only=False)
    inside = np.arange(int(lengths.max(initial=0))) < lengths[:, None]
    if inside.all():
        return values.reshape(inside.shape), inside
    out = np.full(inside.shape, np.nan)
    out[inside] = values
    return out, inside


def rebuilt(cand: pa.Array, p: np.ndarray, missing: np.ndarray) -> pa.Array:
    """``cand`` with other probabilities, given for all candidates one after the other."""
    lengths = pc.fill_null(pc.list_value_length(cand), 0).to_numpy(zero_copy_only=False)
    flat = cand.flatten()
    entries = pa.StructArray.from_arrays([flat.field("mcs"), pa.array(p, pa.float64(), mask=missing), flat.field("eff")], ["mcs", "p", "eff"])
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), entries, mask=cand.is_null() if cand.null_count else None)


def contexts(df: DataFrame, keys, weight: str = "n") -> DataFrame:
    """Distinct contexts with their number of rows: whatever is chosen per context is then chosen once, and summaries
    take ``weight``. Rows with null keys are contexts too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))


def expand(df: DataFrame, mcs_min: int = MCS_MIN, mcs_max: int = MCS_MAX) -> DataFrame:
    """Long form: every row once per MCS, with its spectral efficiency (a literal explode, no join)."""
    indexes = F.array(*[F.lit(m) for m in range(mcs_min, mcs_max + 1)])
    rows = df.drop("mcs") if "mcs" in df.columns else df
    return rows.withColumn("mcs", F.explode(indexes)).withColumn("eff", efficiency_column("mcs"))


def unpack(df: DataFrame, cand: str = "cand") -> DataFrame:
    return df.drop("mcs", "p", "eff").withColumn("_c", F.explode(cand)).select("*", "_c.*").drop("_c", cand)


def pack(scored: DataFrame, keys, cand: str = "cand") -> DataFrame:
    """Scored long rows back to one candidate array per key (at most 28 entries each)."""
    return scored.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("mcs", "p", "eff"))).alias(cand))


def score_contexts(df: DataFrame, context, scorer: Callable[[DataFrame], DataFrame], mcs_min: int = MCS_MIN,
                   mcs_max: int = MCS_MAX) -> DataFrame:
    """Candidates from a row scorer (adds ``p``): distinct contexts are scored once and joined back."""
    keys = list(context)
    distinct = df.select(*keys).distinct()
    packed = pack(scorer(expand(distinct, mcs_min, mcs_max)), keys).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(packed, match).drop(*[f"_k_{k}" for k in keys])
