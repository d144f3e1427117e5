"""Candidate expansion, decision policies, sweeps and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radio
from ..functions.expr import weighted_mean
from ..operators import candidates, lut, policy, replay
from ..operators.candidates import contexts
from ..plans import decision_flow
from ..session import spread
from .luts import NEAREST_2D, _coarse
from .registry import query
from .tables import CAND, KEY_SQL, MCS, ROW_KEY, TX, p_sql, pass_probability, scored, transmissions
from .tables import scored_contexts as contexts_with_candidates

TAU = 0.9
C_KEY = ", ".join(f"c.{k}" for k in ROW_KEY)

BEST_P = "arg_max({v}, (cp, -m))"
FEAS = f"max(m) FILTER (cp >= {TAU}::DOUBLE)"
ARGMAX_P = "arg_max(m, (cp, -m))"
TPUT = "arg_max(m, (cp * ceff, -m))"
CONSTRAINED = f"arg_max(m, (cp * ceff, -m)) FILTER (cp >= {TAU}::DOUBLE)"

# Chosen MCS per row and policy.
PICKS = f"""{TX}, {CAND},
picks AS (
  SELECT {KEY_SQL}, coalesce({FEAS}, {ARGMAX_P}) AS thr, {FEAS} AS feas, {ARGMAX_P} AS best, {TPUT} AS tput, {CONSTRAINED} AS cons,
    any_value(cqi) AS cqi, any_value(snr) AS snr, any_value(ele_angle) AS ele_angle
  FROM cand GROUP BY {KEY_SQL})
"""


def _joined(choice: str, extra: str = "", key: str = "k") -> str:
    """Join a chosen MCS with its candidate."""
    return f"""SELECT {C_KEY}, c.m AS rec_mcs, c.cp AS rec_prob, c.ceff AS rec_eff, c.cp * c.ceff AS rec_expected
FROM picks p JOIN cand c USING ({KEY_SQL}) WHERE c.m = {choice}"""


def _recommend(spark, sf_dir, **kw):
    df = scored(spark, sf_dir).select(*ROW_KEY, "cand")
    return policy.recommend(df, **kw)


_ROUND = "rec_prob rec_expected"


@query("J12_candidate_expansion", f"WITH {TX}, {CAND} SELECT m AS mcs, count(*) AS rows, avg(cp) AS p, any_value(ceff) AS eff FROM cand GROUP BY 1", "p")
def candidate_expansion(spark, sf_dir):
    long = candidates.expand(transmissions(spark, sf_dir).select(*ROW_KEY, "snr"))
    scored_rows = long.withColumn("p", pass_probability(F.col("snr"), F.col("mcs")))
    return scored_rows.groupBy("mcs").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("p"), F.first("eff").alias("eff"))


@query("J12_scored_contexts", f"WITH {TX}, {CAND} SELECT {KEY_SQL}, {TPUT} AS mcs FROM cand GROUP BY {KEY_SQL}")
def scored_contexts(spark, sf_dir):
    df = transmissions(spark, sf_dir).select(*ROW_KEY, "snr")
    packed = candidates.score_contexts(df, ["snr"], lambda d: d.withColumn("p", pass_probability(F.col("snr"), F.col("mcs"))))
    return packed.select(*ROW_KEY, policy.throughput_choice()["mcs"].alias("mcs"))


@query("J16_actual_vs_recommended", f"WITH {PICKS} SELECT t.mcs AS actual, p.thr AS recommended, count(*) AS rows FROM tx t JOIN picks p USING ({KEY_SQL}) GROUP BY ALL")
def actual_vs_recommended(spark, sf_dir):
    rec = policy.recommend(scored(spark, sf_dir).select(*ROW_KEY, "mcs", "cand"), "threshold", TAU, fallback="argmax_p")
    return rec.groupBy(F.col("mcs").alias("actual"), F.col("rec_mcs").alias("recommended")).agg(F.count(F.lit(1)).alias("rows"))


@query("R1_threshold_argmax_fallback", f"WITH {PICKS} {_joined('p.thr')}", _ROUND)
def threshold_argmax(spark, sf_dir):
    return _recommend(spark, sf_dir, objective="threshold", tau=TAU, fallback="argmax_p")


@query("R1_threshold_min_zero_fallback", f"""WITH {PICKS} SELECT {C_KEY}, c.m AS rec_mcs, CASE WHEN p.feas IS NULL THEN 0.0 ELSE c.cp END AS rec_prob, c.ceff AS rec_eff,
CASE WHEN p.feas IS NULL THEN 0.0 ELSE c.cp END * c.ceff AS rec_expected FROM picks p JOIN cand c USING ({KEY_SQL}) WHERE c.m = coalesce(p.feas, 0)""", _ROUND)
def threshold_min_zero(spark, sf_dir):
    return _recommend(spark, sf_dir, objective="threshold", tau=TAU)


@query("R1_threshold_min_p_fallback", f"WITH {PICKS} {_joined('coalesce(p.feas, 0)')}", _ROUND)
def threshold_min_p(spark, sf_dir):
    return _recommend(spark, sf_dir, objective="threshold", tau=TAU, fallback="min_p")


@query("R2_throughput", f"WITH {PICKS} {_joined('p.tput')}", _ROUND)
def throughput(spark, sf_dir):
    return _recommend(spark, sf_dir, objective="throughput")


@query("R3_constrained_throughput", f"WITH {PICKS} {_joined('coalesce(p.cons, p.best)')}", _ROUND)
def constrained(spark, sf_dir):
    return _recommend(spark, sf_dir, objective="constrained", tau=TAU)


@query("R4_guardrailed_throughput", f"WITH {PICKS} {_joined('coalesce(p.cons, 0)')}", _ROUND)
def guardrailed(spark, sf_dir):
    return _recommend(spark, sf_dir, objective="guardrail", guardrail=TAU)


_CQI_TABLE = "[" + ", ".join(str(m) for m in radio.CQI_TO_MCS) + "]"
_MAPS = {
    "round": "CAST(least(greatest(round_even(cqi, 0), 0), 27) AS INTEGER)",
    "linear": "CAST(least(greatest(round_even(2.7::DOUBLE * cqi, 0), 0), 27) AS INTEGER)",
    "table": f"({_CQI_TABLE})[cqi + 1]",
}


def _baseline(name, **kw):
    @query(f"R5_cqi_baseline_{name}", f"""WITH {PICKS}, b AS (SELECT *, {_MAPS[name]} AS base FROM picks)
SELECT {C_KEY}, c.m AS rec_mcs, c.cp AS rec_prob FROM b p JOIN cand c USING ({KEY_SQL}) WHERE c.m = p.base""", "rec_prob")
    def run(spark, sf_dir):
        df = scored(spark, sf_dir).select(*ROW_KEY, policy.cqi_choice("cqi", mapping=name).alias("pick"))
        return df.select(*ROW_KEY, F.col("pick.mcs").alias("rec_mcs"), F.col("pick.p").alias("rec_prob"))

    return run


for _name in _MAPS:
    _baseline(_name)


@query("R6_guardrail_override", f"""WITH {PICKS} SELECT {C_KEY}, c.m AS rec_mcs, c.cp AS rec_prob
FROM picks p JOIN cand c USING ({KEY_SQL}) WHERE c.m = coalesce(p.feas, p.cqi)""", "rec_prob")
def guardrail_override(spark, sf_dir):
    df = scored(spark, sf_dir).select(*ROW_KEY, policy.cqi_choice("cqi", TAU).alias("pick"))
    return df.select(*ROW_KEY, F.col("pick.mcs").alias("rec_mcs"), F.col("pick.p").alias("rec_prob"))


_LUT_PICK = f"""{NEAREST_2D}, {CAND},
lp AS (SELECT {KEY_SQL}, nc.mcs AS lut_mcs FROM tx JOIN nc ON nc.s = CAST(round_even(snr / 0.1::DOUBLE, 0) AS BIGINT) AND nc.c = tx.cqi)
"""


@query("R7_lut_baseline", f"""WITH {_LUT_PICK} SELECT {C_KEY}, c.m AS rec_mcs, c.cp AS rec_prob FROM lp p JOIN cand c USING ({KEY_SQL}) WHERE c.m = least(greatest(p.lut_mcs, 1), 20)""", "rec_prob")
def lut_baseline(spark, sf_dir):
    df = lut.lookup_snr_cqi(scored(spark, sf_dir).select(*ROW_KEY, "snr", "cqi", "cand"), _coarse(spark, sf_dir))
    picked = df.withColumn("pick", policy.lut_choice("lut_mcs", mcs_min=1, mcs_max=20))
    return picked.select(*ROW_KEY, F.col("pick.mcs").alias("rec_mcs"), F.col("pick.p").alias("rec_prob"))


ORDER = ["ts", *ROW_KEY]

_SERIES = f"""ser AS (
  SELECT {KEY_SQL}, ue_id, snr, cqi, bler, row_number() OVER (PARTITION BY ue_id ORDER BY ts, {KEY_SQL}) AS i FROM tx)"""


def p_of(m):
    return p_sql("s.snr", m)


_OLLA_MCS = "CAST(least(greatest(round_even(s.cqi + ({up} * (s.i - 1) - 0.25::DOUBLE * {k}), 0), 0), 27) AS INTEGER)"
_UP = repr(0.25 * 0.1)


_OLLA = f"""{_SERIES},
r AS (
  SELECT ue_id, i, {_OLLA_MCS.format(up=_UP + '::DOUBLE', k='0')} AS olla_mcs,
    CAST({p_of(_OLLA_MCS.format(up=_UP + '::DOUBLE', k='0'))} < 0.9::DOUBLE AS INTEGER) AS k FROM ser s WHERE i = 1
  UNION ALL
  SELECT s.ue_id, s.i, {_OLLA_MCS.format(up=_UP + '::DOUBLE', k='r.k')},
    r.k + CAST({p_of(_OLLA_MCS.format(up=_UP + '::DOUBLE', k='r.k'))} < 0.9::DOUBLE AS INTEGER)
  FROM r JOIN ser s ON s.ue_id = r.ue_id AND s.i = r.i + 1)"""


@query("R8_olla_replay", f"WITH RECURSIVE {TX}, {_OLLA} SELECT {KEY_SQL}, olla_mcs FROM r JOIN ser USING (ue_id, i)")
def olla(spark, sf_dir):
    df = scored(spark, sf_dir, unrolled=True).select(*ROW_KEY, "ts", "ue_id", "cqi", "cand")
    return replay.olla(df, ["ue_id"], ORDER).select(*ROW_KEY, "olla_mcs")


_STEP = """CAST(least(greatest(CASE WHEN s.bler > 0.05::DOUBLE THEN s.cqi WHEN s.bler < 0.05::DOUBLE AND s.cqi > {v} THEN s.cqi
  WHEN s.bler < 0.05::DOUBLE AND s.cqi < {v} THEN {v} WHEN s.bler = 0 THEN s.cqi + 1 ELSE s.cqi END, 1), 15) AS INTEGER)"""


@query("R9_allocator_replay", f"""WITH RECURSIVE {TX}, {_SERIES},
r AS (
  SELECT ue_id, i, {_STEP.format(v='1')} AS alloc_cqi FROM ser s WHERE i = 1
  UNION ALL
  SELECT s.ue_id, s.i, {_STEP.format(v='r.alloc_cqi')} FROM r JOIN ser s ON s.ue_id = r.ue_id AND s.i = r.i + 1)
SELECT {KEY_SQL}, alloc_cqi FROM r JOIN ser USING (ue_id, i)""")
def allocator(spark, sf_dir):
    df = transmissions(spark, sf_dir).select(*ROW_KEY, "ts", "ue_id", "cqi", "bler")
    return replay.allocator(df, ["ue_id"], ORDER, 0.05, block_rows=2000).select(*ROW_KEY, "alloc_cqi")


_STACK = f"""{_LUT_PICK}, picks AS (
  SELECT {KEY_SQL}, coalesce({FEAS}, {ARGMAX_P}) AS thr, {TPUT} AS tput, any_value(cqi) AS cqi FROM cand GROUP BY {KEY_SQL}),
st AS (
  SELECT 'model_threshold' AS policy, c.* FROM picks p JOIN cand c USING ({KEY_SQL}) WHERE c.m = p.thr
  UNION ALL SELECT 'model_throughput', c.* FROM picks p JOIN cand c USING ({KEY_SQL}) WHERE c.m = p.tput
  UNION ALL SELECT 'baseline_cqi', c.* FROM picks p JOIN cand c USING ({KEY_SQL}) WHERE c.m = p.cqi
  UNION ALL SELECT 'baseline_snr_cqi_table', c.* FROM lp p JOIN cand c USING ({KEY_SQL}) WHERE c.m = p.lut_mcs)
"""


def _stacked(spark, sf_dir):
    """Choices of every policy, once per context; elevations are whole degrees here, which the bins keep apart."""
    rows = contexts(transmissions(spark, sf_dir).withColumn("ele_angle", F.floor("ele_angle").cast("double")), ["snr", "cqi", "ele_angle"])
    scored_rows = candidates.candidates(rows, lambda m: pass_probability(F.col("snr"), m))
    df = lut.lookup_snr_cqi(scored_rows, _coarse(spark, sf_dir))
    return policy.stack(df, decision_flow.policy_choices(TAU, lut_mcs="lut_mcs"), ["ele_angle", "n"])


@query("R11_policy_summary", f"""WITH {_STACK} SELECT policy, 1.0::DOUBLE AS accept_rate, 1 - avg(cp) AS violation, avg(cp * ceff) AS throughput_expected,
  avg(cp * ceff) AS throughput_realized, avg(m) AS avg_mcs FROM st GROUP BY policy""", "violation throughput_expected throughput_realized avg_mcs")
def policy_summary(spark, sf_dir):
    return policy.policy_summary(_stacked(spark, sf_dir), weight="n")


@query("R12_elevation_series", f"WITH {_STACK} SELECT floor(ele_angle) AS ele_bin, policy, avg(1 - cp) AS bler, avg(m) AS mcs, count(*) AS rows FROM st GROUP BY ALL", "bler mcs")
def elevation_series(spark, sf_dir):
    return policy.elevation_series(_stacked(spark, sf_dir), weight="n")


@query("R11_policy_comparison_with_olla", f"""WITH RECURSIVE {_STACK}, {_OLLA}, every AS (
  SELECT policy, m, cp, ceff FROM st
  UNION ALL SELECT 'baseline_cqi_olla', c.m, c.cp, c.ceff FROM r JOIN ser USING (ue_id, i) JOIN cand c USING ({KEY_SQL}) WHERE c.m = r.olla_mcs)
SELECT policy, 1.0::DOUBLE AS accept_rate, 1 - avg(cp) AS violation, avg(cp * ceff) AS throughput_expected, avg(cp * ceff) AS throughput_realized, avg(m) AS avg_mcs
FROM every GROUP BY policy""", "violation throughput_expected throughput_realized avg_mcs")
def policy_comparison(spark, sf_dir):
    """Whole comparison plan with the offset loop and the table baseline."""
    rows = transmissions(spark, sf_dir).select(*ROW_KEY, "ts", "ue_id", "snr", "cqi", "ele_angle")
    score = lambda df: candidates.candidates(df, lambda m: pass_probability(F.col("snr"), m))
    summary, _ = decision_flow.compare_policies(rows, score, TAU, ["ue_id"], ORDER, _coarse(spark, sf_dir))
    return summary


_TAUS = policy.sweep_taus(25)
_TAU_ROWS = ", ".join(f"({t!r}::DOUBLE)" for t in _TAUS)
_SWEEP = f"""{TX}, {CAND}, taus(tau) AS (VALUES {_TAU_ROWS}),
ch AS (SELECT tau, {KEY_SQL}, max(m) AS m FROM cand JOIN taus ON cp >= tau GROUP BY ALL),
acc AS (SELECT tau, count(*) AS n, avg(c.cp) AS rel, avg(c.cp * c.ceff) AS t FROM ch JOIN cand c USING ({KEY_SQL}, m) GROUP BY tau)
"""


@query("R13_acceptance_sweep", f"""WITH {_SWEEP} SELECT tau, coalesce(n, 0) / (SELECT count(*) FROM tx) AS accept_rate, coalesce(rel, 0) AS reliability_acc, coalesce(t, 0) AS tput_acc,
  coalesce(n, 0) / (SELECT count(*) FROM tx) * coalesce(t, 0) AS tput_agg FROM taus LEFT JOIN acc USING (tau)""", "accept_rate reliability_acc tput_acc tput_agg")
def acceptance_sweep(spark, sf_dir):
    return policy.acceptance_sweep(contexts_with_candidates(spark, sf_dir, "snr"), _TAUS, weight="n")


@query("R14_pareto", f"""WITH {_SWEEP}, b AS (SELECT {KEY_SQL}, {TPUT} AS m FROM cand GROUP BY {KEY_SQL}),
pt AS (SELECT avg(c.cp) AS rel, avg(c.cp * c.ceff) AS t FROM b JOIN cand c USING ({KEY_SQL}, m))
SELECT 'threshold' AS series, tau, coalesce(n, 0) / (SELECT count(*) FROM tx) AS accept_rate, coalesce(rel, 0) AS reliability_acc, coalesce(t, 0) AS tput_acc,
  coalesce(n, 0) / (SELECT count(*) FROM tx) * coalesce(t, 0) AS tput_agg FROM taus LEFT JOIN acc USING (tau)
UNION ALL SELECT 'throughput', NULL, 1.0, rel, t, t FROM pt""", "accept_rate reliability_acc tput_acc tput_agg")
def pareto(spark, sf_dir):
    return policy.pareto(contexts_with_candidates(spark, sf_dir, "snr"), _TAUS, weight="n")


@query("R15_guardrail_by_elevation", f"""WITH {TX}, {CAND}, t(target, tau) AS (VALUES {', '.join(f'({t}::DOUBLE, {1.0 - t!r}::DOUBLE)' for t in (0.001, 0.01, 0.05, 0.10))}),
ch AS (SELECT target, {KEY_SQL}, coalesce(max(m) FILTER (cp >= tau), 0) AS m FROM cand CROSS JOIN t GROUP BY ALL)
SELECT floor(c.ele_angle) AS ele_bin, target, avg(1 - c.cp) AS bler_avg, avg(c.m) AS mcs_avg FROM ch JOIN cand c USING ({KEY_SQL}, m) GROUP BY ALL""", "bler_avg mcs_avg")
def guardrail_by_elevation(spark, sf_dir):
    return policy.guardrail_by_elevation(scored(spark, sf_dir).select("ele_angle", "cand"))


@query("R15_own_target_by_elevation", f"""WITH {TX}, {CAND},
ch AS (SELECT {KEY_SQL}, coalesce(max(m) FILTER (cp >= 1 - own_target), 0) AS m FROM cand GROUP BY ALL)
SELECT floor(c.ele_angle) AS ele_bin, c.own_target AS target, avg(1 - c.cp) AS bler_avg, avg(c.m) AS mcs_avg FROM ch JOIN cand c USING ({KEY_SQL}, m) GROUP BY ALL""", "bler_avg mcs_avg")
def own_target_by_elevation(spark, sf_dir):
    return policy.guardrail_by_elevation(scored(spark, sf_dir).select("ele_angle", "target_bler", "cand"), own_target="target_bler")


@query("R16_what_if", f"""WITH {TX}, {CAND} SELECT m AS mcs, cp >= {TAU}::DOUBLE AS passes, avg(cp) AS p, any_value(ceff) AS eff, count(*) AS rows FROM cand WHERE m IN (5, 10, 15, 20, 25) GROUP BY ALL""", "p")
def what_if(spark, sf_dir):
    rows = policy.what_if(scored(spark, sf_dir).select(*ROW_KEY, "cand"), [5, 10, 15, 20, 25], TAU)
    return rows.groupBy("mcs", "passes").agg(F.avg("p").alias("p"), F.first("eff").alias("eff"), F.count(F.lit(1)).alias("rows"))


@query("M4_monotone_probability", f"""WITH {TX}, {MCS}, w AS (SELECT {KEY_SQL}, m.mcs, {p_sql('snr', '((m.mcs * 5) % 28)')} AS p FROM tx CROSS JOIN mcs_table m),
low AS (SELECT mcs, min(p) OVER (PARTITION BY {KEY_SQL} ORDER BY mcs) AS p FROM w)
SELECT mcs, avg(p) AS p, count(DISTINCT p) AS distinct_p FROM low GROUP BY 1""", "p")
def monotone_probability(spark, sf_dir):
    from ..operators.modelling import monotone_probability as lower
    tx = spread(contexts(transmissions(spark, sf_dir), ["snr"]))
    df = candidates.candidates(tx, lambda m: pass_probability(F.col("snr"), F.pmod(m * 5, F.lit(28))), unrolled=True)
    rows = candidates.unpack(df.select("n", lower("cand").alias("cand")))
    return rows.groupBy("mcs").agg(weighted_mean("p", "n").alias("p"), F.count_distinct("p").alias("distinct_p"))
