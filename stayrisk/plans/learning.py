"""Registered queries backed by MLlib models (rows-only checks: trained
models have no SQL twin).  Each reads the bookings table; one boosted model
per session and source is fitted, saved with its sidecar, reloaded, and
shared by scoring, importance and attribution queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..constants import FEATURE_COLUMNS, THRESHOLD
from ..functions import features as fx
from ..operators import encode as en
from ..operators import explain as ex
from ..operators import learn as ln
from ..operators import treeshap as ts
from ..operators.boost import LEARNERS
from ..operators.encoder import FeatureEncoder
from ..session import shared_dir
from ..sources import files
from ..sources.bookings import bookings, source_stamp
from ..sources.bookings import duckdb_with_bookings as W
from .registry import query

_CACHE: dict[tuple, object] = {}


def _key(spark, sf, what):
    return (spark.sparkContext.applicationId, sf, source_stamp(spark, sf), what)


def _frame(spark, sf):
    return ln.model_frame(bookings(spark, sf))


def _split(spark, sf):
    """Stratified 80/20 split, written once per session to the shared folder."""
    k = _key(spark, sf, "split")
    if k not in _CACHE:
        _CACHE[k] = ln.write_and_read(en.stratified_split(_frame(spark, sf), 0.2), "split")
    parts = _CACHE[k]
    return parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test")


def shared_model(spark, sf, kind: str = "gbt_shallow") -> PipelineModel:
    """Fit once on the train split, save (A06), load back.  ``stack`` is the
    model that scores; ``gbt_shallow`` is the one that is explained."""
    k = _key(spark, sf, f"model-{kind}")
    if k not in _CACHE:
        train, _ = _split(spark, sf)
        model = ln.fit_stacking(train) if kind == "stack" else ln.fit_pipeline(train, kind)
        path = f"{shared_dir(spark)}/model-{kind}-{uuid.uuid4().hex[:8]}"
        files.save_model(model, path, {"kind": kind, "threshold": THRESHOLD, "features": FEATURE_COLUMNS})
        _CACHE[k] = files.load_model(path)[0]
    return _CACHE[k]


@query("fit_logistic")
def q_fit_logistic(spark, sf):
    return ln.fit_and_evaluate(*_split(spark, sf), "logistic")


@query("fit_forest")
def q_fit_forest(spark, sf):
    return ln.fit_and_evaluate(*_split(spark, sf), "forest")


@query("fit_boosted")
def q_fit_boosted(spark, sf):
    """The three second-order learners, fitted in shared passes."""
    train, test = _split(spark, sf)
    enc = FeatureEncoder().fit(train)
    models = ln.fit_kinds({0: enc}, {0: ln.written_matrix(enc, train)}, {0: tuple(LEARNERS)})
    return _evaluated(LEARNERS, lambda k: ln.score(PipelineModel(stages=[enc, models[0, k]]), test, k))


@query("fit_boosted_first_order")
def q_fit_boosted_first_order(spark, sf):
    """MLlib's first-order boosting in three sizes."""
    train, test = _split(spark, sf)
    return _evaluated(("gbt_shallow", "gbt_deep", "gbt_sub"), lambda k: ln.score(ln.fit_pipeline(train, k), test, k))


def _evaluated(kinds, scored):
    parts = ln.fit_many([lambda k=k: ln.write_and_read(ln.evaluate_scores(scored(k)).select(F.lit(k).alias("model"), "*"), f"eval-{k}")
                         for k in kinds])
    out = parts[0]
    for r in parts[1:]:
        out = out.unionByName(r)
    return out


@query("voting")
def q_voting(spark, sf):
    train, test = _split(spark, sf)
    enc = FeatureEncoder().fit(train)
    s = ln.vote(ln.fit_voting(enc, ln.written_matrix(enc, train)), enc.transform(test))
    return ln.evaluate_scores(s, "p_vote").select(F.lit("voting").alias("model"), "*")


@query("stacking")
def q_stacking(spark, sf):
    _, test = _split(spark, sf)
    s = ln.score(shared_model(spark, sf, "stack"), test, "stack")
    return ln.evaluate_scores(s).select(F.lit("stacking").alias("model"), "*")


def score_bookings(df, model, kind: str = "stack"):
    """originals + cancel_probability (4 places, half-even), prediction
    (unrounded >= 0.60), risk_label.  No label is needed; missing fillable
    columns are filled for the model only."""
    originals = df.columns
    d = df.withColumns({f"_in_{i}": F.col(c) for i, c in enumerate(originals)})
    fm = fx.feature_matrix(d, keep=[f"_in_{i}" for i in range(len(originals))], fill_missing=True)
    s = model.transform(fm).withColumn("p", ln.p1(f"prob_{kind}"))
    return s.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(originals)],
                    fx.prob_round("p").alias("cancel_probability"),
                    fx.decision("p").alias("prediction"), fx.risk_label("p").alias("risk_label"))


@query("batch_score_model")
def q_batch_score_model(spark, sf):
    """F14 with the trained stack."""
    return score_bookings(bookings(spark, sf), shared_model(spark, sf, "stack"))


@query("score_csv")
def q_score_csv(spark, sf):
    """An uploaded batch end to end: CSV without the label -> contract ->
    features -> saved stack -> CSV, read back."""
    path = f"{shared_dir(spark)}/upload-{uuid.uuid4().hex[:8]}"
    rows = bookings(spark, sf).drop("is_canceled", "score")  # built before both jobs

    def uploaded():
        files.write_with_null_tokens(rows, path)
        batch = files.scan_csv(spark, path)
        bad = files.batch_contract(batch).filter("action = 'error'").collect()
        if bad:
            raise ValueError(f"missing required columns: {[r['column'] for r in bad]}")
        return batch

    # the upload fills the gaps between the fits' short stages
    batch, model = ln.fit_many([uploaded, lambda: shared_model(spark, sf, "stack")], parallelism=2)
    files.write_scored(score_bookings(batch, model), path + "-scored", fmt="csv")
    return files.scan_csv(spark, path + "-scored")


def _cv(spark, sf):
    k = _key(spark, sf, "cv")
    if k not in _CACHE:
        train, _ = _split(spark, sf)
        _CACHE[k] = ln.cv_models(train)
    return _CACHE[k]


@query("model_ranking")
def q_model_ranking(spark, sf):
    return ln.model_ranking(_cv(spark, sf))


@query("cv_models")
def q_cv_models(spark, sf):
    return _cv(spark, sf)


def _trials(spark, sf):
    k = _key(spark, sf, "trials")
    if k not in _CACHE:
        train, _ = _split(spark, sf)
        _CACHE[k] = ln.Trials(train, hashlib.sha256(repr(source_stamp(spark, sf)).encode()).hexdigest()[:20])
    return _CACHE[k]


def _tuned(spark, sf, method):
    k = _key(spark, sf, f"tune-{method}")
    if k not in _CACHE:
        store = _trials(spark, sf)
        start = ln.grid_trials() + ln.random_trials()
        if method == "compare":  # both searches share their passes
            store.scores(start)
        trials = {"grid": ln.grid_trials, "random": ln.random_trials, "parzen": lambda: ln.parzen_trials(store, start), "compare": list}[method]()
        _CACHE[k] = store.table(trials, method)
    return _CACHE[k]


@query("tuning_grid")
def q_tuning_grid(spark, sf):
    return _tuned(spark, sf, "grid")


@query("tuning_random")
def q_tuning_random(spark, sf):
    return _tuned(spark, sf, "random")


@query("tuning_compare")
def q_tuning_compare(spark, sf):
    """grid, random and Parzen search of each learner."""
    _tuned(spark, sf, "compare")
    return ln.tuning_compare(ln._union([_tuned(spark, sf, m) for m in ("grid", "random", "parzen")]))


@query("tuning_parzen")
def q_tuning_parzen(spark, sf):
    return _tuned(spark, sf, "parzen")


def _spread_frame(spark, sf):
    """The model frame in tasks of a bounded number of bookings."""
    return ln.model_frame(ln.spread(bookings(spark, sf)))


def _featurized(spark, sf, df=None):
    model = shared_model(spark, sf)
    feat = PipelineModel(stages=model.stages[:-1]).transform(df if df is not None else _spread_frame(spark, sf))
    return model, feat


@query("gain_importance")
def q_gain_importance(spark, sf):
    model, feat = _featurized(spark, sf)
    names = ex.feature_names(feat, "features")
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, share double")


@query("importance_top10")
def q_importance_top10(spark, sf):
    return ex.importance_topk(q_gain_importance(spark, sf), 10)


@query("local_shap")
def q_local_shap(spark, sf):
    """Attribution per booking and feature slot (margin scale), ranked within
    the booking, |shap| > 0.0001 kept after ranking."""
    model, feat = _featurized(spark, sf)
    names = ex.feature_names(feat, "features")
    sv = ts.tree_shap(feat, model.stages[-1])
    return ex.positive_attributions(ex._ranked_from_arrays(sv, "booking_id", names, "shap"))


@query("global_shap")
def q_global_shap(spark, sf):
    """Mean |shap| per feature slot over all bookings, top 10 ranked."""
    model, feat = _featurized(spark, sf)
    names = ex.feature_names(feat, "features")
    sv = ts.tree_shap(feat, model.stages[-1])
    long = ex._ranked_from_arrays(sv, "booking_id", names, "shap")
    m = ex.mean_abs_attribution(long).withColumnRenamed("mean_abs_shap", "share")
    return ex.importance_topk(m, 10).withColumnRenamed("share", "mean_abs_shap")


# Checks of what SQL cannot compute but can state: each has a twin.
@query("local_shap_adds_up", W("SELECT booking_id, true AS adds_up, true AS ranks_complete FROM bookings"))
def q_local_shap_adds_up(spark, sf):
    """Per booking: base + attributions = the model's margin, and ranks 1..n.
    All of it is found in the booking's own row."""
    model, feat = _featurized(spark, sf)
    names = ex.feature_names(feat, "features")
    raw = model.stages[-1].transform(feat).withColumn("raw", vector_to_array("raw_gbt_shallow")[1])
    sv = ts.tree_shap(raw, model.stages[-1], keep=["raw"]).withColumn("ranks", ex.ranking_of_arrays(names, "shap")["rank"])
    return sv.select(
        "booking_id", (F.abs(F.col("margin") - F.col("raw")) < 1e-9).alias("adds_up"),
        ((F.size(F.array_distinct("ranks")) == len(names)) & (F.array_max("ranks") == len(names))).alias("ranks_complete"))


@query("gain_shares_sum", "SELECT true AS sums_to_one, true AS none_negative")
def q_gain_shares_sum(spark, sf):
    return q_gain_importance(spark, sf).agg((F.abs(F.sum("share") - 1) < 1e-9).alias("sums_to_one"),
                                            (F.min("share") >= 0).alias("none_negative"))


@query("model_artifact", W("SELECT booking_id, true AS same FROM bookings"))
def q_model_artifact(spark, sf):
    """A booking's probability before and after save and load.  Both models score
    the booking's own row, so nothing is joined."""
    d = _spread_frame(spark, sf)
    model = shared_model(spark, sf)
    path = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex[:8]}"
    files.save_model(model, path, {"threshold": THRESHOLD})
    before = ln.score(model, d, "gbt_shallow", "_before").select(*d.columns, "_before")
    after = ln.score(files.load_model(path)[0], before, "gbt_shallow", "_after")
    return after.select("booking_id", (F.col("_before") == F.col("_after")).alias("same"))


def _logistic(spark, sf):
    model = shared_model(spark, sf, "logistic")
    return model.stages[-1], PipelineModel(stages=model.stages[:-1]).transform(_spread_frame(spark, sf))


@query("logistic_attribution")
def q_logistic_attribution(spark, sf):
    """G16 of the fitted logistic model, ranked per booking."""
    model, feat = _logistic(spark, sf)
    return ex.vector_attribution(feat, ln.linear_weights(model), ex.feature_names(feat, "features"))


@query("logistic_attribution_adds_up", W("SELECT booking_id, true AS adds_up FROM bookings"))
def q_logistic_attribution_adds_up(spark, sf):
    """G16 with fitted weights: a booking's attributions, as ranked, sum to its
    margin minus the mean margin."""
    model, feat = _logistic(spark, sf)
    margin = model.transform(feat).withColumn("m", vector_to_array("raw_logistic")[1])
    d = ex.vector_shap(margin, ln.linear_weights(model), keep=["m"])
    total = F.aggregate(ex.ranking_of_arrays(ex.feature_names(feat, "features"), "shap")["shap"], F.lit(0.0), lambda a, v: a + v)
    d = ln.write_and_read(d.select("booking_id", "m", total.alias("total")), "margins")
    mean = d.agg(F.avg("m")).first()[0]
    return d.select("booking_id", (F.abs(F.col("total") - (F.col("m") - F.lit(mean))) < 1e-6).alias("adds_up"))
