"""Registered queries: evaluation, cost, encoders, splits, attributions.

Evaluation runs on the bookings table with the fixture ``score`` in the
model's place, so every metric has an exact SQL twin; the MLlib-trained
versions live in :mod:`stayrisk.plans.learning`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import encode as en
from ..operators import evaluate as ev
from ..operators import explain as ex
from ..sources.bookings import bookings, duckdb_with_bookings as W
from . import sql_snippets as S
from .dashboard import scored
from .registry import query

D = "DOUBLE"
SC = f"sc AS ({S.SCORED})"
CONF = ("conf AS (SELECT tn, fp, fn, tp, tn + fp + fn + tp AS total FROM (SELECT "
        "count(*) FILTER (WHERE is_canceled = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE is_canceled = 0 AND prediction = 1) AS fp, "
        "count(*) FILTER (WHERE is_canceled = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE is_canceled = 1 AND prediction = 1) AS tp FROM sc))")
EVAL = SC + ",\n" + CONF


def _conf(spark, sf):
    return ev.confusion(scored(spark, sf))


# ---------------------------------------------------------------- G01-G12
@query("confusion", W("SELECT *, tn / nullif(total, 0) * 100 AS tn_pct, fp / nullif(total, 0) * 100 AS fp_pct, "
                      "fn / nullif(total, 0) * 100 AS fn_pct, tp / nullif(total, 0) * 100 AS tp_pct FROM conf", EVAL))
def q_confusion(spark, sf):
    return _conf(spark, sf)


_METRICS = ("(tp + tn) / nullif(total, 0) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, "
            "2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, "
            f"CAST(1.25 AS {D}) * tp / nullif(CAST(1.25 AS {D}) * tp + CAST(0.25 AS {D}) * fn + fp, 0) AS f05")


@query("class_metrics", W(f"SELECT {_METRICS} FROM conf", EVAL))
def q_class_metrics(spark, sf):
    return ev.class_metrics(_conf(spark, sf))


@query("fp_tp_ratio", W("SELECT fp, tp, fp / nullif(tp, 0) AS fp_tp_ratio FROM conf", EVAL))
def q_fp_tp_ratio(spark, sf):
    return ev.fp_tp_ratio(_conf(spark, sf))


_COUNTS = ("c AS (SELECT score AS s, count(*) FILTER (WHERE is_canceled = 1) AS pos, count(*) FILTER (WHERE is_canceled = 0) AS neg "
           "FROM bookings WHERE score IS NOT NULL AND is_canceled IS NOT NULL GROUP BY score), "
           "b AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below FROM c "
           "WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")


@query("auc_roc", W(f"SELECT n_pos, n_neg, CAST(num2 AS {D}) / (CAST(2.0 AS {D}) * n_pos * n_neg) AS auc_roc FROM "
                    "(SELECT sum(2 * CAST(pos AS HUGEINT) * neg_below + CAST(pos AS HUGEINT) * neg) AS num2, "
                    "CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b)", _COUNTS))
def q_auc_roc(spark, sf):
    return ev.auc_roc(bookings(spark, sf))


@query("auc_pr", W("SELECT round(sum(CASE WHEN pos > 0 THEN (pos / P) * ((P - pos_below) / ((P - pos_below) + (N - neg_below))) "
                   "ELSE 0.0 END), 9) + 0.0 AS auc_pr FROM b, (SELECT CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM c)",
                   _COUNTS))
def q_auc_pr(spark, sf):
    return ev.auc_pr(bookings(spark, sf))


@query("brier", W("SELECT round(avg((score - is_canceled) ^ 2), 9) + 0.0 AS brier FROM bookings"))
def q_brier(spark, sf):
    return ev.brier(bookings(spark, sf))


@query("calibration", W(
    "SELECT bin, n, round(mp, 9) + 0.0 AS mean_p, observed_rate, round(g, 9) + 0.0 AS gap, round(avg(g) OVER (), 9) + 0.0 AS mean_gap FROM "
    "(SELECT *, abs(mp - observed_rate) AS g FROM (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, "
    "avg(score) AS mp, avg(is_canceled) AS observed_rate FROM bookings WHERE score IS NOT NULL GROUP BY 1))"))
def q_calibration(spark, sf):
    return ev.calibration(bookings(spark, sf))


_SWEEP = ("sw AS (SELECT j / 100 AS threshold, tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, "
          f"CAST(1.25 AS {D}) * tp / nullif(CAST(1.25 AS {D}) * tp + CAST(0.25 AS {D}) * fn + fp, 0) AS f05, fp * 700 + fn * 300 AS cost FROM "
          "(SELECT j, count(*) FILTER (WHERE score >= j / 100 AND is_canceled = 1) AS tp, count(*) FILTER (WHERE score >= j / 100 AND is_canceled = 0) AS fp, "
          "count(*) FILTER (WHERE score < j / 100 AND is_canceled = 1) AS fn, count(*) FILTER (WHERE score < j / 100 AND is_canceled = 0) AS tn "
          "FROM range(0, 101) AS r(j), bookings WHERE score IS NOT NULL AND is_canceled IS NOT NULL GROUP BY j))")


@query("threshold_sweep", W("SELECT * FROM sw", _SWEEP))
def q_threshold_sweep(spark, sf):
    return ev.threshold_sweep(bookings(spark, sf))


@query("best_threshold", W("SELECT * FROM sw ORDER BY cost ASC, threshold ASC LIMIT 1", _SWEEP))
def q_best_threshold(spark, sf):
    return ev.best_threshold(ev.threshold_sweep(bookings(spark, sf)))


def _cost_cols(cfp, cfn):
    return (f"fp * {cfp} AS fp_cost, fn * {cfn} AS fn_cost, fp * {cfp} + fn * {cfn} AS model_cost, (fn + tp) * {cfn} AS base_cost, "
            f"(fn + tp) * {cfn} - (fp * {cfp} + fn * {cfn}) AS savings, "
            f"((fn + tp) * {cfn} - (fp * {cfp} + fn * {cfn})) / nullif((fn + tp) * {cfn}, 0) * 100 AS savings_pct, "
            f"CASE WHEN fp * {cfp} > fn * {cfn} THEN 'False Positive' ELSE 'False Negative' END AS dominant_error, "
            f"CASE WHEN fn * {cfn} > 0 THEN (fp * {cfp}) / (fn * {cfn}) ELSE 0.0 END AS fp_fn_ratio")


@query("cost_summary", W("SELECT 700 AS cost_fp, 300 AS cost_fn, fp_cost, fn_cost, model_cost, base_cost, savings, savings_pct FROM "
                         f"(SELECT {_cost_cols(700, 300)} FROM conf)", EVAL))
def q_cost_summary(spark, sf):
    return ev.cost_summary(_conf(spark, sf))


@query("cost_dominance", W(f"SELECT fp_cost, fn_cost, dominant_error, fp_fn_ratio FROM (SELECT {_cost_cols(700, 300)} FROM conf)", EVAL))
def q_cost_dominance(spark, sf):
    return ev.cost_dominance(_conf(spark, sf))


@query("cost_scenarios", W(
    "SELECT cost_fp, cost_fn, fp_cost, fn_cost, model_cost, base_cost, savings, savings_pct, dominant_error, fp_fn_ratio FROM "
    f"(SELECT cost_fp, cost_fn, {_cost_cols('cost_fp', 'cost_fn')} FROM conf, "
    "(SELECT CAST(a AS INTEGER) AS cost_fp FROM generate_series(100, 2000, 50) t(a)), "
    "(SELECT CAST(b AS INTEGER) AS cost_fn FROM generate_series(100, 2000, 50) t(b)))", EVAL))
def q_cost_scenarios(spark, sf):
    return ev.cost_scenarios(_conf(spark, sf))


# ---------------------------------------------------------------- F01-F08
@query("country_topk_learn", W(
    "SELECT b.booking_id, b.country, coalesce(t.country, 'Other') AS country_learned FROM bookings b LEFT JOIN "
    "(SELECT country FROM bookings WHERE country IS NOT NULL GROUP BY country ORDER BY count(*) DESC, country ASC LIMIT 36) t "
    "ON b.country = t.country"))
def q_country_topk_learn(spark, sf):
    b = bookings(spark, sf).select("booking_id", "country")
    return en.lookup_country(b, en.learn_top_countries(b, 36))


ONEHOT_LEVELS = {
    "parking_bin": ["has_parking", "no_parking"], "babies_bin": ["has_baby", "no_baby"],
    "children_bin": ["has_children", "no_children"],
    "prev_cancel_bin": ["never", "once", "multiple"], "prev_loyal_bin": ["none", "some", "many"],
    "booking_changes_bin": ["none", "some", "many"],
    "arrival_season": ["Winter", "Spring", "Summer", "Fall"], "meal": ["BB", "HB", "FB", "SC"],
}
_OH_SRC = {"parking_bin": S.PARKING_BIN, "babies_bin": S.BABIES_BIN, "children_bin": S.CHILDREN_BIN,
           "prev_cancel_bin": S.PREV_CANCEL_BIN, "prev_loyal_bin": S.PREV_LOYAL_BIN,
           "booking_changes_bin": S.CHANGES_BIN, "arrival_season": S.season(S.MONTH_NUM), "meal": "meal"}


@query("onehot", W("SELECT booking_id, " + ", ".join(
    f"coalesce(CAST({c} = '{lv}' AS INTEGER), 0) AS {c}_{lv}" for c, lvs in ONEHOT_LEVELS.items() for lv in lvs)
    + " FROM (SELECT booking_id, " + ", ".join(f"{e} AS {c}" for c, e in _OH_SRC.items()) + " FROM bookings)"))
def q_onehot(spark, sf):
    fm = fx.feature_matrix(bookings(spark, sf)).select("booking_id", "meal", *[c for c in ONEHOT_LEVELS if c != "meal"])
    for c, lvs in ONEHOT_LEVELS.items():
        fm = en.onehot(fm, c, lvs)
    return fm.drop(*ONEHOT_LEVELS)


@query("binary_encode", W(
    "SELECT b.booking_id, b.market_segment, " + ", ".join(
        f"CAST((coalesce(code, 0) >> {2 - i}) & 1 AS INTEGER) AS market_segment_{i}" for i in range(3))
    + " FROM bookings b LEFT JOIN (SELECT market_segment, dense_rank() OVER (ORDER BY market_segment) AS code FROM "
    "(SELECT DISTINCT market_segment FROM bookings WHERE market_segment IS NOT NULL)) c ON b.market_segment = c.market_segment"))
def q_binary_encode(spark, sf):
    return en.binary_encode(bookings(spark, sf).select("booking_id", "market_segment"), "market_segment")


@query("target_encode", W(
    f"SELECT b.booking_id, b.agent, coalesce((s.s + CAST(10.0 AS {D}) * p.prior) / (s.n + CAST(10.0 AS {D})), p.prior) AS agent_te "
    "FROM bookings b LEFT JOIN (SELECT agent, CAST(sum(is_canceled) AS BIGINT) AS s, count(is_canceled) AS n FROM bookings "
    "WHERE is_canceled IS NOT NULL AND agent IS NOT NULL GROUP BY agent) s ON b.agent = s.agent, (SELECT avg(is_canceled) AS prior FROM bookings) p"))
def q_target_encode(spark, sf):
    b = bookings(spark, sf).select("booking_id", "agent", "is_canceled")
    return en.target_encode(b, "agent").drop("is_canceled")


@query("target_encode_ordered", W(
    f"SELECT booking_id, agent, CASE WHEN agent IS NULL THEN p.prior ELSE (coalesce(sum(is_canceled) OVER w, 0) + CAST(10.0 AS {D}) * p.prior) "
    f"/ (count(is_canceled) OVER w + CAST(10.0 AS {D})) END AS agent_te "
    "FROM (SELECT *, (booking_id % 2147483647 + 11) % 2147483647 * 48271 % 2147483647 AS h FROM bookings), (SELECT avg(is_canceled) AS prior FROM bookings) p "
    "WINDOW w AS (PARTITION BY agent ORDER BY h, booking_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def q_target_encode_ordered(spark, sf):
    """F04 by ordered target statistics."""
    b = bookings(spark, sf).select("booking_id", "agent", "is_canceled")
    return en.target_encode_ordered(b, "agent", seed=11).drop("is_canceled")


_FOLDS = ("f AS (SELECT *, CAST(((row_number() OVER (PARTITION BY is_canceled ORDER BY h, booking_id) - 1) % 5) + 1 AS INTEGER) AS fold "
          "FROM (SELECT *, (booking_id % 2147483647) * 48271 % 2147483647 AS h FROM bookings))")


@query("target_encode_oof", W(
    f"SELECT f.booking_id, f.agent, f.fold, coalesce(((tot.S - coalesce(per.s, 0)) + CAST(10.0 AS {D}) * ((al.aS - fs.fs) / (al.aN - fs.fn))) "
    f"/ ((tot.N - coalesce(per.n, 0)) + CAST(10.0 AS {D})), (al.aS - fs.fs) / (al.aN - fs.fn)) AS agent_te FROM f "
    "LEFT JOIN per ON f.agent = per.agent AND f.fold = per.fold LEFT JOIN tot ON f.agent = tot.agent "
    "LEFT JOIN fs ON f.fold = fs.fold, al",
    _FOLDS + ", per AS (SELECT agent, fold, CAST(sum(is_canceled) AS BIGINT) AS s, count(is_canceled) AS n FROM f "
    "WHERE is_canceled IS NOT NULL AND agent IS NOT NULL GROUP BY agent, fold), "
    "tot AS (SELECT agent, CAST(sum(s) AS BIGINT) AS S, CAST(sum(n) AS BIGINT) AS N FROM per GROUP BY agent), "
    "fs AS (SELECT fold, CAST(sum(is_canceled) AS BIGINT) AS fs, count(is_canceled) AS fn FROM f WHERE is_canceled IS NOT NULL GROUP BY fold), "
    "al AS (SELECT CAST(sum(is_canceled) AS BIGINT) AS aS, count(is_canceled) AS aN FROM f)"))
def q_target_encode_oof(spark, sf):
    from ..operators.learn import write_and_read
    b = write_and_read(en.stratified_folds(bookings(spark, sf).select("booking_id", "agent", "is_canceled"), 5),
                       "folds")
    return en.target_encode_oof(b, "agent").select("booking_id", "agent", "fold", "agent_te")


def _lrs(c):
    v = f"ln(1 + {c})"
    return (f"round((({v}) - (SELECT quantile_cont({v}, 0.5) FROM bookings)) / nullif((SELECT quantile_cont({v}, 0.75) FROM bookings) "
            f"- (SELECT quantile_cont({v}, 0.25) FROM bookings), 0), 9) + 0.0")


@query("log_robust_scale", W(f"SELECT booking_id, lead_time, adr, {_lrs('lead_time')} AS lead_time_rs, {_lrs('adr')} AS adr_rs FROM bookings"))
def q_log_robust_scale(spark, sf):
    b = bookings(spark, sf).select("booking_id", "lead_time", "adr")
    return en.log_robust_scale(b, ["lead_time", "adr"])


@query("class_weight", W("SELECT is_canceled, count(*) AS n, (SELECT count(*) FROM bookings WHERE is_canceled IS NOT NULL) / (2 * count(*)) AS weight "
                         "FROM bookings WHERE is_canceled IS NOT NULL GROUP BY is_canceled"))
def q_class_weight(spark, sf):
    return en.class_weights(bookings(spark, sf))


@query("stratified_split", W(
    f"SELECT booking_id, is_canceled, CASE WHEN rn <= floor(nc * CAST(0.2 AS {D}) + CAST(0.5 AS {D})) THEN 'test' ELSE 'train' END AS split FROM "
    "(SELECT *, row_number() OVER (PARTITION BY is_canceled ORDER BY h, booking_id) AS rn, count(*) OVER (PARTITION BY is_canceled) AS nc "
    "FROM (SELECT booking_id, is_canceled, (booking_id % 2147483647) * 48271 % 2147483647 AS h FROM bookings))"))
def q_stratified_split(spark, sf):
    b = bookings(spark, sf).select("booking_id", "is_canceled")
    return en.stratified_split(b, 0.2)


@query("stratified_folds", W("SELECT booking_id, is_canceled, fold FROM f", _FOLDS))
def q_stratified_folds(spark, sf):
    return en.stratified_folds(bookings(spark, sf).select("booking_id", "is_canceled"), 5)


@query("cv_table", W(
    "SELECT fold, f05, precision, recall, round(avg(f05) OVER (), 9) + 0.0 AS f05_mean, round(stddev_samp(f05) OVER (), 9) + 0.0 AS f05_sd FROM "
    f"(SELECT fold, CAST(1.25 AS {D}) * tp / nullif(CAST(1.25 AS {D}) * tp + CAST(0.25 AS {D}) * fn + fp, 0) AS f05, "
    "tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM "
    "(SELECT fold, count(*) FILTER (WHERE is_canceled = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE is_canceled = 1 AND prediction = 0) AS fn, "
    f"count(*) FILTER (WHERE is_canceled = 1 AND prediction = 1) AS tp FROM (SELECT *, {S.decision('score')} AS prediction FROM f) GROUP BY fold))",
    _FOLDS))
def q_cv_table(spark, sf):
    from ..operators.learn import cv_table
    b = en.stratified_folds(bookings(spark, sf), 5).withColumn("prediction", fx.decision("score"))
    return cv_table(b)


# ---------------------------------------------------------------- attributions
def _attr_frame(spark, sf):
    return bookings(spark, sf).withColumns({"no_commitment": fx.no_commitment(),
                                            "lead_x_transient": fx.lead_x_transient(),
                                            "is_weekend_only": fx.is_weekend_only()})


_ATTR = ("d AS (SELECT *, " + f"{S.NO_COMMITMENT} AS no_commitment, {S.LEAD_X_TRANSIENT} AS lead_x_transient, "
         f"{S.IS_WEEKEND_ONLY} AS is_weekend_only FROM bookings), "
         "m AS (SELECT " + ", ".join(f"avg({f}) AS {f}" for f in ex.LINEAR_WEIGHTS) + " FROM d), "
         "lo AS (" + " UNION ALL ".join(
             f"SELECT d.booking_id, '{f}' AS feature, CAST({w} AS {D}) * (d.{f} - m.{f}) AS shap FROM d, m"
             for f, w in ex.LINEAR_WEIGHTS.items()) + "), "
         "rk AS (SELECT booking_id, feature, shap, abs(shap) AS abs_shap, row_number() OVER (PARTITION BY booking_id "
         "ORDER BY abs(shap) DESC, feature ASC) AS rank, CASE WHEN shap > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM lo)")


def _linear(spark, sf):
    return ex.linear_attribution(_attr_frame(spark, sf))


@query("linear_attribution", W("SELECT * FROM rk", _ATTR))
def q_linear_attribution(spark, sf):
    return _linear(spark, sf)


@query("shap_rank", W("SELECT booking_id, feature, abs_shap, rank FROM rk", _ATTR))
def q_shap_rank(spark, sf):
    return _linear(spark, sf).select("booking_id", "feature", "abs_shap", "rank")


@query("shap_top3", W("SELECT * FROM rk WHERE rank <= 3", _ATTR))
def q_shap_top3(spark, sf):
    return ex.top_attributions(_linear(spark, sf), 3)


@query("shap_top12", W("SELECT * FROM rk WHERE rank <= 12", _ATTR))
def q_shap_top12(spark, sf):
    return ex.top_attributions(_linear(spark, sf), 12)


@query("positive_attributions", W("SELECT * FROM rk WHERE abs_shap > 0.0001", _ATTR))
def q_positive_attributions(spark, sf):
    return ex.positive_attributions(_linear(spark, sf))
