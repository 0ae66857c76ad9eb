"""Golden values from the published confusion counts, brute-force checks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrisk.operators import evaluate as ev
from stayrisk.operators.learn import cv_table


def test_published_confusion_golden(spark):
    conf = ev.confusion_from_counts(spark, 17425, 1192, 2813, 4350)
    m = ev.class_metrics(conf).first()
    assert round(m["accuracy"], 4) == 0.8446
    assert round(m["precision"], 4) == 0.7849
    assert round(m["recall"], 4) == 0.6073
    assert round(m["f1"], 4) == 0.6848
    assert round(m["f05"], 4) == 0.7415
    assert round(ev.fp_tp_ratio(conf).first()["fp_tp_ratio"], 2) == 0.27
    c = ev.cost_summary(conf).first()
    assert (c["fp_cost"], c["fn_cost"], c["base_cost"], c["model_cost"], c["savings"]) == \
        (834400, 843900, 2148900, 1678300, 470600)
    assert round(c["savings_pct"], 1) == 21.9
    d = ev.cost_dominance(conf).first()
    assert d["dominant_error"] == "False Negative" and round(d["fp_fn_ratio"], 4) == round(834400 / 843900, 4)
    shares = conf.first()
    assert round(shares["tn_pct"], 1) == 67.6 and round(shares["tp_pct"], 1) == 16.9
    assert ev.cost_scenarios(conf).count() == 39 * 39


def test_published_folds(spark):
    f05 = [0.7374, 0.7388, 0.7269, 0.7348, 0.7305]
    s = pd.Series(f05)
    assert round(s.mean(), 4) == 0.7337 and round(s.std(), 4) == 0.0049


def _scores(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, 40) / 40.0) for i in range(n)]   # many ties
    return rows, spark.createDataFrame(rows, "booking_id long, is_canceled int, score double")


def test_auc_brute_force_with_ties(spark):
    rows, df = _scores(spark)
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    got = ev.auc_roc(df).first()["auc_roc"]
    assert got == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    # invariant under a monotone rescale
    sq = df.withColumn("score", F.col("score") * F.col("score") * 3 + 1)
    assert ev.auc_roc(sq).first()["auc_roc"] == pytest.approx(got, abs=1e-12)


def test_average_precision_brute_force(spark):
    rows, df = _scores(spark, 300, 5)
    P = sum(y for _, y, _ in rows)
    ap = 0.0
    for s in sorted({s for _, _, s in rows}, reverse=True):
        tp = sum(1 for _, y, x in rows if y == 1 and x >= s)
        fp = sum(1 for _, y, x in rows if y == 0 and x >= s)
        dpos = sum(1 for _, y, x in rows if y == 1 and x == s)
        ap += dpos / P * tp / (tp + fp)
    assert ev.auc_pr(df).first()["auc_pr"] == pytest.approx(ap, abs=1e-8)


def test_threshold_sweep_brute_force(spark):
    rows, df = _scores(spark, 300, 7)
    sw = {round(r["threshold"], 2): r for r in ev.threshold_sweep(df).collect()}
    assert len(sw) == 101
    for j in (0, 17, 29, 60, 100):
        t = j / 100
        tp = sum(1 for _, y, s in rows if y == 1 and s >= t)
        fp = sum(1 for _, y, s in rows if y == 0 and s >= t)
        assert (sw[t]["tp"], sw[t]["fp"]) == (tp, fp)
    best = ev.best_threshold(ev.threshold_sweep(df)).first()
    assert best["cost"] == min(r["cost"] for r in sw.values())


def test_degenerate_no_positives(spark):
    df = spark.createDataFrame([(1, 0, 0.3), (2, 0, 0.7)], "booking_id long, is_canceled int, score double")
    s = df.withColumn("prediction", (F.col("score") >= 0.6).cast("int"))
    m = ev.class_metrics(ev.confusion(s)).first()
    assert m["recall"] is None and m["precision"] == 0.0
    assert ev.auc_roc(df).first()["auc_roc"] is None


def test_cv_table_sample_sd(spark):
    rows = []
    rnd = random.Random(11)
    for i in range(500):
        rows.append((i % 5 + 1, rnd.randint(0, 1), rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "fold int, is_canceled int, prediction int")
    t = cv_table(df).toPandas()
    assert len(t) == 5
    assert t["f05_sd"].iloc[0] == pytest.approx(round(t["f05"].std(), 9), abs=1e-9)


def test_decision_uses_unrounded_probability(spark):
    from stayrisk.functions import features as fx
    df = spark.createDataFrame([(0.59996,), (0.6,)], "p double")
    r = df.select(fx.prob_round("p").alias("shown"), fx.decision("p").alias("pred")).collect()
    assert r[0]["shown"] == 0.6 and r[0]["pred"] == 0          # S9: shows 0.6, not a cancel
    assert r[1]["pred"] == 1                                   # tie at the threshold cancels


def test_cost_guards_and_dominance_ties(spark):
    conf = ev.confusion_from_counts(spark, 10, 3, 0, 0)       # no FN, no TP
    d = ev.cost_dominance(conf).first()
    assert d["fp_fn_ratio"] == 0.0                             # S21: FN cost 0 -> ratio 0
    assert ev.cost_summary(conf).first()["savings_pct"] is None  # base cost 0 -> no division
    tie = ev.confusion_from_counts(spark, 10, 3, 7, 5)         # 3*700 == 7*300
    assert ev.cost_dominance(tie).first()["dominant_error"] == "False Negative"   # S23
