"""Registered queries against their check SQL. A short list by default; CORVIDA_FULL=1 runs them all."""

import os

import pytest
from parity import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SHORT = ["flagship_error_profile", "prj1_to_numeric", "prj2_clean_numeric", "prj12_structural_filter", "prj21_scheme_labels", "agg2_error_metrics", "agg9_target_statistics",
         "agg11_target_correlations", "win9_keep_last_upsert", "win10_journal_decision", "join5_duplicate_spectrum", "join9_substitution_pairs", "join17_scope_match",
         "spc5_band_descriptors", "val2_kfold", "val10_bootstrap_oob", "ad1_leverage", "unc2_conformal_interval", "src6_jcamp_points", "src8_json_record"]
NAMES = sorted(entry.queries()) if os.environ.get("CORVIDA_FULL") else SHORT


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.schema is not None and df.count() >= 0
        return
    ok, message = compare(con, df, sql)
    assert ok, message
