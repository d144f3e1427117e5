"""A spread of registered queries against their SQL twins on the smallest driver tables."""

import pytest
from compare import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = """S2_pdsch_events S4_measurement_reports J1_first_feedback J4_nearest_measurement J5_bucket_measurement
A1_snr_error_curve A9_column_profile W2_cumulative W3_trailing_means W5_windowed_error_rate_compat W5_windowed_error_rate W3_trailing_means_of_fractions L6_interpolation_lut M4_isotonic_pass_rate J2_consuming_feedback
M1_logistic_all_rows M10_logistic_scoring M10_recommend_logistic R11_policy_comparison_with_olla M11_logistic_round_trip O6_portable_split M8_quadratic_fit M8_cubic_fit_all_rows L5_fitted_polynomial_lut
R1_threshold_argmax_fallback R4_guardrailed_throughput R8_olla_replay R9_allocator_replay R11_policy_summary
R13_acceptance_sweep L1_empirical_lut_filled L2_model_lut J10_nearest_snr_cqi J11_exact_lookup
E3_reliability E6_areas E8_tradeoff_by_slice M5_calibrated_threshold ST3_per_second ST2_feedback_join ST2_consuming_feedback
ST7_violation_rate ST6_offset_loop A18_label_pivot A20_lut_pivot R12_elevation_series R14_pareto J15_nearest_rows""".split()


@pytest.fixture(scope="module")
def con():
    connection = duck(SF)
    connection.execute("SET TimeZone='UTC'")
    return connection


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    from linkops.catalog import oracles, registered

    assert compare(spark, con, registered()[key], oracles()[key], SF) is None


def test_entry_contract(spark):
    import __spark_entry__ as contract

    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert contract.entry(spark).count() == 4
