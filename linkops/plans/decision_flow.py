"""Scored candidates to policy comparison and evaluation reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, lut, policy, replay
from ..session import materialize


def policy_choices(tau: float, guardrail: float | None = None, lut_mcs: str | None = None, olla_mcs: str | None = None,
                   **mapping) -> dict[str, Column]:
    """Choice columns of the compared policies; tables and the offset loop take part when their columns exist."""
    choices = {
        "model_threshold": policy.threshold_choice(tau),
        "model_throughput": policy.throughput_choice(),
        "baseline_cqi": policy.cqi_choice("cqi", guardrail, **mapping),
    }
    if olla_mcs:
        choices["baseline_cqi_olla"] = policy.fixed_choice(F.col(olla_mcs))
    if lut_mcs:
        choices["baseline_snr_cqi_table"] = policy.lut_choice(lut_mcs, guardrail)
    return choices


def compare_policies(df: DataFrame, score: Callable[[DataFrame], DataFrame], tau: float, series, order,
                     table: DataFrame | None = None, step: float = 0.25, target: float = 0.1,
                     guardrail: float | None = None, width: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Policy summary and elevation series from one stacked frame. ``score`` adds the candidates to ``df``.

    The offset loop runs on rows without the candidate arrays, which are added again for the comparison.
    """
    rows = score(replay.olla(score(df), series, order, step, target))
    if table is not None:
        rows = lut.lookup_snr_cqi(rows, table)
    choices = policy_choices(tau, guardrail, "lut_mcs" if table is not None else None, "olla_mcs")
    stacked = materialize(policy.stack(rows, choices, ["ele_angle"]), "policies")
    return policy.policy_summary(stacked), policy.elevation_series(stacked, width=width)


def evaluation(scored: DataFrame, tau: float, slice_column: str, bins: int = 15, steps: int = 99, slices: int = 8,
               min_count: int = 1) -> dict[str, DataFrame]:
    """Every table of the evaluation report; the scored rows are staged once and read by all of them."""
    rows = materialize(scored, "scored")
    curve = evaluate.tradeoff(rows, evaluate.tradeoff_grid(steps))
    by_slice = evaluate.slice_tradeoff(rows, slice_column, evaluate.tradeoff_grid(steps), slices, min_count)
    table = evaluate.wilson(evaluate.reliability(rows, bins))
    return {
        "losses": evaluate.log_loss(rows),
        "errors": evaluate.probability_errors(rows),
        "reliability": table,
        "calibration_error": evaluate.calibration_error(table),
        "tradeoff": curve,
        "tradeoff_by_slice": by_slice,
        "at_threshold": evaluate.row_at(curve, tau),
        "worst_slice": evaluate.worst_slice(by_slice, slice_column, tau),
    }
