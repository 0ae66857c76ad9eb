"""Learning helpers: one-row parity, voting, ranking, tuning comparison."""

import pytest
from pyspark.sql import functions as F

from stayrisk.operators import learn as ln
from stayrisk.sources.bookings import bookings


@pytest.fixture(scope="module")
def small_model(spark, sf):
    df = ln.model_frame(bookings(spark, sf))
    return df, ln.fit_pipeline(df, "gbt_shallow", maxIter=5)


def test_one_row_scores_like_inside_batch(spark, small_model):
    df, model = small_model
    full = {r["booking_id"]: r["p"] for r in ln.score(model, df, "gbt_shallow").select("booking_id", "p").collect()}
    for bid in (0, 7, 42):
        one = df.filter(F.col("booking_id") == bid)
        p = ln.score(model, one, "gbt_shallow").select("p").first()[0]
        assert p == pytest.approx(full[bid], abs=1e-12)


def test_evaluate_scores_shape(spark, small_model):
    df, model = small_model
    ev = ln.evaluate_scores(ln.score(model, df, "gbt_shallow")).first()
    assert 0.0 <= ev["auc_roc"] <= 1.0 and 0.0 <= ev["brier"] <= 1.0 and ev["f05"] is not None


def test_vote_is_member_mean(spark, small_model):
    df, _ = small_model
    feat_model = ln.fit_featurizer(df)
    feat = feat_model.transform(df)
    members = [("logistic", ln.classifier("logistic").setMaxIter(5).fit(feat)),
               ("gbt_shallow", ln.classifier("gbt_shallow").setMaxIter(3).fit(feat))]
    v = ln.vote(members, feat).select("p_vote", "p_logistic", "p_gbt_shallow").collect()
    for r in v[:20]:
        assert r["p_vote"] == pytest.approx((r["p_logistic"] + r["p_gbt_shallow"]) / 2, abs=1e-15)


def test_model_ranking_and_tuning_compare(spark):
    cv = spark.createDataFrame([("a", 1, 0.70, 0.8, 0.5), ("a", 2, 0.72, 0.8, 0.5),
                                ("b", 1, 0.75, 0.8, 0.5), ("b", 2, 0.73, 0.8, 0.5)],
                               "model string, fold int, f05 double, precision double, recall double")
    r = {x["model"]: x for x in ln.model_ranking(cv).collect()}
    assert r["b"]["rank"] == 1 and r["a"]["rank"] == 2
    assert r["a"]["f05_sd"] == pytest.approx(0.0141421356, abs=1e-9)
    # published tuning table: the sequential sampler wins for all three models
    rows = []
    for model, rand, grid, opt in [("CatBoost", 0.7232, 0.7210, 0.7233), ("LightGBM", 0.7230, 0.7188, 0.7246),
                                   ("XGBoost", 0.7232, 0.7156, 0.7256)]:
        rows += [(model, "random", "", rand), (model, "grid", "", grid), (model, "optuna", "", opt)]
    t = ln.tuning_compare(spark.createDataFrame(rows, "model string, method string, params string, f05 double"))
    got = {x["model"]: (x["best_method"], x["best_f05"], x["grid"]) for x in t.collect()}
    assert got == {"CatBoost": ("optuna", 0.7233, 0.7210), "LightGBM": ("optuna", 0.7246, 0.7188),
                   "XGBoost": ("optuna", 0.7256, 0.7156)}


def test_segment_codes_take_as_many_bits_as_needed(spark, sf):
    df = ln.model_frame(bookings(spark, sf))
    many = df.withColumn("market_segment", F.concat(F.lit("S"), (F.col("booking_id") % 8).cast("string")))
    feat = ln.fit_featurizer(many)
    odd = many.limit(20).withColumn("market_segment", F.when(F.col("booking_id") % 2 == 0, "unseen"))
    d = feat.transform(many.unionByName(odd))
    codes = d.groupBy("market_segment").agg(F.collect_set(F.array(*[f"market_segment_{i}" for i in range(4)])).alias("c")).collect()
    by = {r["market_segment"]: [tuple(x) for x in r["c"]] for r in codes}
    assert all(len(c) == 1 for c in by.values())
    assert by["unseen"] == by[None] == [(0.0, 0.0, 0.0, 0.0)]
    assert len({c[0] for s, c in by.items() if s and s != "unseen"}) == 8 and (0.0,) * 4 not in [by[f"S{i}"][0] for i in range(8)]


def test_noise_category_does_not_look_predictive(spark, sf):
    """With ids drawn at random in place of agents, features of training rows
    must not give away their labels."""
    df = ln.model_frame(bookings(spark, sf)).withColumn("agent", (F.xxhash64("booking_id") % 700).cast("double"))
    feat = ln.fit_featurizer(df)
    leak = feat.transform(df).agg(F.corr("agent_te_num", "is_canceled")).first()[0]
    clean = ln.train_matrix(feat, df).agg(F.corr("agent_te_num", "is_canceled")).first()[0]
    assert leak > 0.3 and abs(clean) < 0.1


def test_null_and_unseen_agents_get_the_prior(spark, sf):
    df = ln.model_frame(bookings(spark, sf))
    feat = ln.fit_featurizer(df)
    prior = df.agg(F.avg("is_canceled")).first()[0]
    odd = df.limit(6).withColumn("agent", F.when(F.col("booking_id") % 2 == 0, F.lit(99999.0)))
    assert {round(r[0], 12) for r in feat.transform(odd).select("agent_te_num").collect()} == {round(prior, 12)}


def test_stack_saves_and_scores_without_label(spark, sf, tmp_path):
    from pyspark.ml import PipelineModel
    df = ln.model_frame(bookings(spark, sf))
    stack = ln.fit_stacking(df, kinds=("boost_level", "forest"), k=2)
    stack.save(str(tmp_path / "stack"))
    again = PipelineModel.load(str(tmp_path / "stack"))
    p = lambda m, d: {r["booking_id"]: r["p"] for r in ln.score(m, d, "stack").select("booking_id", "p").collect()}
    assert p(stack, df) == p(again, df.drop("is_canceled", "weight"))


def test_models_have_their_full_size(spark):
    """Sizes of the fitted models; searches run at the learners' own rounds and
    the ranked stack has as many inner folds as the scoring one."""
    import inspect
    assert ln.classifier("forest").getNumTrees() == 30
    sizes = {k: (ln.classifier(k).getMaxIter(), ln.classifier(k).getStepSize()) for k in ("gbt_shallow", "gbt_deep", "gbt_sub")}
    assert sizes == {"gbt_shallow": (25, 0.2), "gbt_deep": (12, 0.2), "gbt_sub": (20, 0.2)}
    sizes = {k: (h.rounds, h.depth, h.step) for k, h in ln.LEARNERS.items()}
    assert sizes == {"boost_level": (25, 3, 0.2), "boost_leaf": (12, 6, 0.2), "boost_symmetric": (20, 5, 0.2)}
    of = lambda f, name: inspect.signature(f).parameters[name].default
    assert ln.TUNED == tuple(ln.LEARNERS) and of(ln.random_trials, "n") == 4
    assert of(ln.cv_models, "k") - 1 == of(ln.fit_stacking, "k") == 4


def test_no_row_is_scored_by_a_base_that_saw_it(spark, sf, monkeypatch):
    """Each outer fold's inner rows are all rows of the other folds, once, scored
    by bases whose training folds hold neither the row's fold nor the outer one."""
    from dataclasses import replace
    short = {k: replace(h, rounds=1) for k, h in ln.LEARNERS.items()}
    monkeypatch.setattr(ln, "LEARNERS", short)
    df = ln.model_frame(bookings(spark, sf)).filter("booking_id < 600")
    folds = ln.write_and_read(ln.en.stratified_folds(df, 3), "test-folds")
    seen = []
    whole = ln.base_scores
    monkeypatch.setattr(ln, "base_scores", lambda enc, models, rows: seen.append((models, sorted(r[0] for r in rows.select("fold").distinct().collect()))) or whole(enc, models, rows))
    kinds = ("boost_level", "boost_symmetric")
    inner, encoders, models, subsets = ln.nested_scores(folds, 3, kinds)
    of = {id(m): subsets[s] for (s, _), m in models.items()}
    assert len(seen) == 3 and all(not set(of[id(m)]) & set(scored) for ms, scored in seen for m in ms)
    n = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    got = {(r["outer"], r["fold"]): (r["n"], r["d"]) for r in inner.groupBy("outer", "fold").agg(
        F.count("*").alias("n"), F.count_distinct("booking_id").alias("d")).collect()}
    assert got == {(o, f): (n[f], n[f]) for o in n for f in n if o != f}
    # a pair's scores of its two folds come from one fit: the third fold's rows
    assert subsets == {1: [2, 3], 2: [1, 3], 3: [1, 2], 102: [3], 103: [2], 203: [1]}


def test_encoder_is_the_queries_encoders(spark, sf, tmp_path):
    """One answer for F04 and F05 in the query and in the fitted stage, the same
    after saving and loading, and for several training sets at once."""
    from stayrisk.operators import encode as en
    from stayrisk.operators.encoder import FeatureEncoder, FeatureEncoderModel, fit_subsets
    df = ln.model_frame(bookings(spark, sf)).withColumn("agent", F.when(F.col("booking_id") % 3 > 0, F.col("agent")))
    enc = FeatureEncoder().fit(df)
    enc.save(str(tmp_path / "enc"))
    again = FeatureEncoderModel.load(str(tmp_path / "enc"))
    rows = lambda e, d: {r["booking_id"]: (r["agent_te_num"], r["country_te_num"], str(r["features"].toArray().tolist()))
                         for r in e.transform(d).select("booking_id", "agent_te_num", "country_te_num", "features").collect()}
    got = rows(enc, df)
    assert got == rows(again, df) and len(got) == df.count()
    te = {r["booking_id"]: r["agent_te"] for r in en.target_encode(df, "agent").collect()}
    assert all(v[0] == pytest.approx(te[k], abs=1e-12) for k, v in got.items())
    at = {n: i for i, n in enumerate(enc.slots())}
    scaled = {r["booking_id"]: r for r in en.log_robust_scale(df, ["lead_time", "adr"]).collect()}
    vec = {r["booking_id"]: r["features"] for r in enc.transform(df).select("booking_id", "features").collect()}
    assert all(vec[k][at[f"log_scaled_{c}"]] == r[f"{c}_rs"] for k, r in scaled.items() for c in ("lead_time", "adr"))
    folds = ln.write_and_read(en.stratified_folds(df, 3), "test-folds")
    many = fit_subsets(folds, "fold", {7: [1, 3], 9: [1, 2, 3]})
    part = folds.filter("fold != 2")
    assert rows(many[7], part) == rows(FeatureEncoder().fit(part), part) and rows(many[9], df) == got
    oof = en.target_encode_oof(df.withColumn("part", F.pmod(en.portable_hash(), F.lit(5)).cast("int")), "agent", "part")
    oof = {r["booking_id"]: r["agent_te"] for r in oof.collect()}
    train = {r["booking_id"]: r["agent_te_num"] for r in enc.transform_train(df).collect()}
    assert all(train[k] == pytest.approx(v, abs=1e-12) for k, v in oof.items())


def test_trials_are_run_once_and_kept(spark, sf, monkeypatch, tmp_path):
    """A finished trial is read from the shared table, in any later search; other
    parameters, folds or data are other trials."""
    ran = []
    monkeypatch.setattr(ln, "trial_scores", lambda df, trials, k: ran.append(list(trials)) or [0.1 * p["depth"] + p["step"] for _, p in trials])
    import uuid
    df, stamp = spark.range(1), uuid.uuid4().hex
    store = ln.Trials(df, stamp)
    grid, draws = ln.grid_trials(), ln.random_trials()
    assert len(grid) == len(draws) == 12 and store.finished() == {}
    first = store.scores(grid + grid[:2])
    assert len(ran) == 1 and len(ran[0]) == 12 and first[12:] == first[:2]
    assert ln.Trials(df, stamp).scores(grid) == first[:12] and len(ran) == 1
    ln.Trials(df, stamp, k=2).scores(grid[:1])
    assert len(ran) == 2
    found = ln.parzen_trials(store, grid + draws)
    assert [len(r) for r in ran[2:]] == [12, 6, 6] and len(found) == 12
    assert ln.parzen_trials(ln.Trials(df, stamp), grid + draws) == found and len(ran) == 5
    table = ln._union([store.table(t, m) for t, m in ((grid, "grid"), (draws, "random"), (found, "parzen"))])
    r = ln.tuning_compare(table).collect()
    assert len(r) == 3 and all(x["best_f05"] == max(x["grid"], x["random"], x["parzen"]) for x in r)


def test_parzen_proposals_go_where_trials_were_good():
    import math
    goal = lambda p: -abs(p["depth"] - 4) - 3 * abs(math.log(p["step"] / 0.2))
    done = [(p, goal(p)) for p in [{"depth": d, "step": s} for d in (2, 3, 4, 5) for s in (0.06, 0.12, 0.22, 0.38)]]
    near = [goal(p) for seed in range(10) for p in ln.parzen_proposals(done, 3, seed)]
    flat = [goal(p) for _, p in ln.random_trials(30, 3, ("boost_level",))]
    assert sum(near) / len(near) > sum(flat) / len(flat) + 0.5
    one = ln.parzen_proposals(done, 4, 1)
    assert one == ln.parzen_proposals(done, 4, 1) and all(2 <= p["depth"] <= 5 and 0.05 <= p["step"] <= 0.4 for p in one)
    assert len({(p["depth"], p["step"]) for p in one}) == 4 and ln.parzen_proposals([], 2, 1)


def test_trial_scores_are_the_models_scores(spark, sf, monkeypatch):
    """A trial's score is the mean F0.5 of its model over the folds."""
    from dataclasses import replace
    monkeypatch.setattr(ln, "LEARNERS", {k: replace(h, rounds=2) for k, h in ln.LEARNERS.items()})
    df = ln.model_frame(bookings(spark, sf)).filter("booking_id < 500")
    trials = [("boost_level", {"depth": 2, "step": 0.9}), ("boost_symmetric", {"depth": 3, "step": 0.5})]
    got = ln.trial_scores(df, trials, 2)
    folds = ln.write_and_read(ln.en.stratified_folds(df, 2), "test-folds")
    for (kind, params), score in zip(trials, got):
        f05 = []
        for f in (1, 2):
            enc = ln.fit_subsets(folds, "fold", {1: [3 - f]})[1]
            x = ln.written_matrix(enc, folds.filter(F.col("fold") != f))
            m = ln.boost.fit_many(ln.boost_rows(x), [(0, replace(ln.LEARNERS[kind], **params))], enc.binary_slots())[0].named("t", ln.THRESHOLD)
            r = m.transform(enc.transform(folds.filter(F.col("fold") == f))).select(ln.LABEL, "pred_t").collect()
            tp, fp, fn = (sum((a[0], a[1]) == p for a in r) for p in ((1, 1.0), (0, 1.0), (1, 0.0)))
            f05.append(1.25 * tp / (1.25 * tp + 0.25 * fn + fp) if tp else 0.0)
        assert score == pytest.approx(sum(f05) / 2)


def test_slots_are_not_fused_into_one_method(spark, sf):
    """With all slots in a stage's one generated method the JVM never compiles it."""
    df = ln.model_frame(bookings(spark, sf)).filter("booking_id < 200")
    plan = ln.fit_featurizer(df).transform(df).select("features")._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.splitlines() if "AS features" in line]
    assert lines and not any(line.startswith("*(") for line in lines) and "AdaptiveSparkPlan" not in lines[0]


def test_one_hot_slots(spark, sf):
    """One slot of each column's is 1, also for null and unseen values."""
    df = ln.model_frame(bookings(spark, sf)).filter("booking_id < 300")
    enc = ln.fit_featurizer(df.filter("meal <> 'BB'")).stages[0]
    rows = df.withColumn("hotel", F.when(F.col("booking_id") % 3 > 0, F.col("hotel")))
    names = enc.slots()
    for r in enc.transform(rows).select("hotel", "meal", "features").collect():
        x = r["features"].toArray()
        for group in enc.one_hot_slots():
            assert sorted(x[group])[-2:] == [0.0, 1.0] and sum(x[group]) == 1
        for c in ("hotel", "meal"):
            want = f"{c}_ohe_{r[c]}" if f"{c}_ohe_{r[c]}" in names else f"{c}_ohe___unknown"
            assert x[names.index(want)] == 1


def test_forest_keeps_rows_nodes_and_grows_the_same_trees(spark, sf):
    """Rows are not walked down from the root at every level."""
    df = ln.model_frame(bookings(spark, sf))
    enc = ln.FeatureEncoder().fit(df)
    x = ln.written_matrix(enc, df)
    est = ln.classifier("forest")
    assert est.getCacheNodeIds()
    small = {est.numTrees: 5}
    assert est.copy(small).fit(x).toDebugString == est.copy({**small, est.cacheNodeIds: False}).fit(x).toDebugString


def test_large_fits_run_one_at_a_time():
    """What MLlib keeps of the rows of fits that run at once is bounded."""
    assert ln.beside([]) == ln.beside([1000, 1000]) == ln.beside([540_000] * 4 + [720_000]) == 3
    assert ln.beside([1000, 5_400_000]) == ln.beside([43_000_000]) == 1
    assert all(ln.beside([n]) * n <= 12 * ln.TASK_ROWS for n in range(0, 3_000_000, 9_999))


def test_small_files_of_a_meta_table_are_read_by_few_tasks(spark):
    parts = ln._union([spark.range(0, 100, 1, 8) for _ in range(4)])
    few = ln.packed(parts)
    assert parts.rdd.getNumPartitions() == 32 and few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert ln.packed(parts, 50).rdd.getNumPartitions() == 8 and few.count() == 400
