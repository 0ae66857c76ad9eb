"""Plan shape guards: the scale properties the design relies on."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from plan_report import analyse  # noqa: E402

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return analyse(E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["feature_matrix", "batch_score", "prob_round", "risk_action", "onehot",
                                  "linear_attribution", "shap_top3"])
def test_row_level_queries_do_not_shuffle(spark, name):
    p = _plan(spark, name)
    assert p["hash_shuffles"] == 0 and p["range_shuffles"] == 0


@pytest.mark.parametrize("name", ["hotel_stats", "month_hotel_rate", "country_hotel_rate", "season_rate",
                                  "kpi_summary", "risk_mix", "leakage_scan", "category_profile"])
def test_reports_shuffle_once(spark, name):
    assert _plan(spark, name)["hash_shuffles"] <= 2


def test_filters_reach_the_scan(spark):
    assert _plan(spark, "filter_hotel")["scans_with_pushed_filters"] == 1


def test_top_k_is_take_ordered(spark):
    assert _plan(spark, "country_top10")["take_ordered"] == 1


@pytest.mark.parametrize("name", ["stratified_folds", "auc_roc", "threshold_sweep", "target_encode_oof"])
def test_balanced_plans_stay_small(spark, name):
    p = _plan(spark, name)
    assert p["hash_shuffles"] <= 4
