"""Attribution properties: linear exactness, ranking rules, Tree SHAP
additivity and agreement with brute-force Shapley values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrisk.operators import explain as ex
from stayrisk.operators import treeshap as ts


def test_rank_before_filter_and_direction(spark):
    df = spark.createDataFrame([(1, 0.5, -0.7, 0.00005, 0.0)], "booking_id long, a double, b double, c double, d double")
    r = ex._ranked_long(df, "booking_id", [(c, F.col(c)) for c in "abcd"])
    rows = {x["feature"]: x for x in r.collect()}
    assert rows["b"]["rank"] == 1 and rows["a"]["rank"] == 2
    assert rows["b"]["direction"] == "lowers" and rows["a"]["direction"] == "raises"
    assert rows["d"]["direction"] == "lowers"          # zero lowers (not > 0)
    kept = ex.positive_attributions(r).collect()
    assert sorted(x["feature"] for x in kept) == ["a", "b"]
    assert ex.top_attributions(r, 1).first()["feature"] == "b"


def test_linear_attribution_sums_to_centered_logit(spark):
    df = spark.createDataFrame([(i, i % 7, (i * 3) % 5) for i in range(50)], "booking_id long, x int, y int")
    w = {"x": 0.3, "y": -1.2}
    a = ex.linear_attribution(df, w).groupBy("booking_id").agg(F.sum("shap").alias("s"))
    pdf = df.toPandas()
    mx, my = pdf.x.mean(), pdf.y.mean()
    for r in a.collect():
        row = pdf[pdf.booking_id == r["booking_id"]].iloc[0]
        assert r["s"] == pytest.approx(0.3 * (row.x - mx) - 1.2 * (row.y - my), abs=1e-12)


def _toy_tree():
    # node 0: x0 <= 0.5 ; node 1: x1 <= 1.5 ; node 2: x2 in {1.0}
    t = {"left": np.array([1, 3, 5, -1, -1, -1, -1]), "right": np.array([2, 4, 6, -1, -1, -1, -1]),
         "feat": np.array([0, 1, 2, -1, -1, -1, -1]), "thr": np.array([0.5, 1.5, 0, 0, 0, 0, 0]),
         "value": np.array([0, 0, 0, 1.0, -2.0, 3.0, 0.5]),
         "cover": np.array([100.0, 60.0, 40.0, 45.0, 15.0, 10.0, 30.0]), "weight": 0.7, "cats": {2: frozenset({1.0})}}
    return t


def _cond_exp(x, t, S, node=0):
    if t["left"][node] < 0:
        return t["value"][node]
    f = t["feat"][node]
    L, R = t["left"][node], t["right"][node]
    if f in S:
        cats = t["cats"].get(node)
        left = (x[f] in cats) if cats is not None else x[f] <= t["thr"][node]
        return _cond_exp(x, t, S, L if left else R)
    c = t["cover"]
    return (c[L] * _cond_exp(x, t, S, L) + c[R] * _cond_exp(x, t, S, R)) / c[node]


def test_tree_shap_equals_brute_force_shapley():
    t = _toy_tree()
    n = 3
    for x in ([0.0, 1.0, 1.0], [1.0, 2.0, 0.0], [0.2, 3.0, 0.0], [0.9, 0.0, 1.0]):
        x = np.array(x)
        got = ts.shap_values(x, [t], n)
        for i in range(n):
            others = [j for j in range(n) if j != i]
            phi = 0.0
            for k in range(len(others) + 1):
                for S in itertools.combinations(others, k):
                    wgt = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                    phi += wgt * (_cond_exp(x, t, set(S) | {i}) - _cond_exp(x, t, set(S)))
            assert got[i] == pytest.approx(0.7 * phi, abs=1e-12)
        base = 0.7 * ts.expected_value(t)
        leaf = 0.7 * _cond_exp(x, t, {0, 1, 2})
        assert base + got.sum() == pytest.approx(leaf, abs=1e-12)
        assert np.allclose(ts.batch_shap(x[None, :], [t], n)[0], got)


def test_gbt_margin_additivity(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from stayrisk.operators import learn as ln
    from stayrisk.sources.bookings import bookings
    df = ln.model_frame(bookings(spark, sf))
    feat = ln.fit_featurizer(df).transform(df)
    gbt = ln.classifier("gbt_shallow").setMaxIter(4).fit(feat)
    sv = ts.tree_shap(feat, gbt)
    raw = gbt.transform(feat).select("booking_id", vector_to_array("raw_gbt_shallow")[1].alias("m"))
    err = sv.join(raw, "booking_id").select(F.max(F.abs(F.col("margin") - F.col("m")))).first()[0]
    assert err < 1e-9


def test_leaf_tables_equal_the_batch_version_without_python(spark):
    """Native lookups against numpy at 1e-9, with categorical splits, missing
    values and trees that use a feature several times; no Python in the plan."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 4, 400), rng.exponential(size=400)])
    y = ((x[:, 0] + np.isin(x[:, 1], (1, 3)) - x[:, 2] + rng.normal(size=400) * 0.3) > 0).astype(float)
    df = spark.createDataFrame([(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "booking_id long, y double, x array<double>")
    meta = {"ml_attr": {"attrs": {"numeric": [{"idx": 0, "name": "a"}, {"idx": 2, "name": "c"}],
                                  "nominal": [{"idx": 1, "name": "b", "vals": ["0", "1", "2", "3"]}]}, "num_attrs": 3}}
    feat = df.withColumn("features", array_to_vector("x").alias("features", metadata=meta))
    gbt = GBTClassifier(labelCol="y", maxDepth=4, maxIter=5, seed=1).fit(feat)
    trees = ts.gbt_trees(gbt, spark)
    assert any(t["cats"] for t in trees)
    sv = ts.tree_shap(feat, gbt)
    got = np.array([r["shap"] for r in sv.orderBy("booking_id").collect()])
    assert np.abs(got - ts.batch_shap(x, trees, 3)).max() < 1e-9
    plan = sv._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Exchange" not in plan
    odd = spark.createDataFrame([(1, [float("nan"), 2.0, float("nan")])], "booking_id long, x array<double>").withColumn("features", array_to_vector("x"))
    assert np.allclose(ts.tree_shap(odd, gbt).first()["shap"], ts.batch_shap(np.array([[np.nan, 2.0, np.nan]]), trees, 3)[0], atol=1e-9)


def test_sums_and_ranks_of_a_booking_need_no_shuffle(spark, sf):
    """Both checks read a booking's own row; ranks are those of the exploded rows."""
    from stayrisk.plans import QUERIES
    for name in ("local_shap_adds_up", "logistic_attribution_adds_up"):
        d = QUERIES[name](spark, sf)
        assert "Exchange hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
        rows = d.collect()
        assert len(rows) == 1500 and all(all(r[1:]) for r in rows)
    df = spark.createDataFrame([(1, [0.5, -0.7, None, 0.5])], "booking_id long, shap array<double>")
    long = ex._ranked_from_arrays(df, "booking_id", list("dbca"), "shap").orderBy("rank").collect()
    got = df.select(ex.ranking_of_arrays(list("dbca"), "shap")).first()[0]
    assert [(r["rank"], r["feature"], r["shap"]) for r in got] == [(r["rank"], r["feature"], r["shap"]) for r in long]
    assert [r["feature"] for r in got] == ["b", "a", "d", "c"]


def test_tasks_hold_a_bounded_number_of_rows(spark, tmp_path):
    from stayrisk.operators import learn as ln
    spark.range(10_000).withColumnRenamed("id", "booking_id").coalesce(1).write.parquet(str(tmp_path / "t"))
    d = ln.spread(spark.read.parquet(str(tmp_path / "t")), rows=1000)
    sizes = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 2000


def test_ranks_of_arrays_equal_sorted_structs_and_sort_none(spark):
    """Ranks found batch by batch equal those of sorted structs, with ties, zeros, NaN,
    nulls, rows of other lengths and equal names; no struct is sorted."""
    rng = np.random.default_rng(8)
    names = [f"f{i}" for i in rng.permutation(30)]
    rows = [(i, [float(v) for v in np.where(rng.random(30) < 0.3, 0.0, rng.integers(-4, 5, 30) / 7)]) for i in range(200)]
    odd = [(900, [math.nan, None, -1.0, 1.0, None, math.nan, -0.0, 0.0] + [0.5] * 22), (901, [None] * 30)]
    for some, called in ((rows, names), (rows + odd, names), (rows + [(902, None), (903, []), (904, [1.0, -1.0] + [0.0] * 31)], names),
                         (rows, ["x", *names[1:29], "x"])):
        df = spark.createDataFrame(some, "booking_id long, shap array<double>")
        name = F.array(*[F.lit(n) for n in called])
        entries = F.transform("shap", lambda v, i: ex._entry(F.get(name, i), v))
        sort = lambda d: [tuple(map(str, r)) for r in d.orderBy("booking_id", "rank").collect()]
        got = ex._ranked_from_arrays(df, "booking_id", called, "shap")
        assert sort(got) == sort(ex._ranked_entries(df, "booking_id", entries))
        whole = {r["booking_id"]: r["r"] for r in df.select("booking_id", ex.ranking_of_arrays(called, "shap").alias("r")).collect()}
        flat = [tuple(map(str, (k, e["feature"], e["shap"], e["rank"]))) for k in sorted(whole) for e in whole[k] or []]
        assert flat == [(r[0], r[1], r[2], r[4]) for r in sort(got)]
        assert got.schema["rank"].dataType.simpleString() == "bigint"
        assert "sort_array" not in got._jdf.queryExecution().executedPlan().toString()


def test_neighbouring_leaves_share_a_table():
    """A node's two leaves, and small trees whole, are one table a feature; groups of
    any size give the same attributions."""
    t = _toy_tree()
    tests, tables = ts.leaf_tables([t])[0]
    assert len(ts.leaf_tables([t])) == 1 and len(tests) == 3 and all(len(v) == 8 for v in tables.values())
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.random(64), rng.random(64) * 3, rng.integers(0, 2, 64)])
    want = ts.batch_shap(x, [t], 3)
    assert [len(ts.leaf_tables([t], bits)) for bits in (1, 2, 3)] == [2, 2, 1]
    for bits in (1, 2, 3):
        got = np.zeros((64, 3))
        for tests, tables in ts.leaf_tables([t], bits):
            code = sum((np.isin(x[:, 2], [1.0]) if "IN" in c else x[:, int(c[2])] <= float(c.split("<= ")[1][:-1])).astype(int) << i for i, c in enumerate(tests))
            for f, table in tables.items():
                got[:, f] += table[code]
        assert np.abs(got - want).max() < 1e-12


def test_model_artifact_compares_a_booking_in_its_own_row(spark, sf):
    """The model before and after save and load score one row; nothing is shuffled or
    joined by booking."""
    from stayrisk.plans import QUERIES
    d = QUERIES["model_artifact"](spark, sf)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "booking_id#" in plan
    rows = d.collect()
    assert len(rows) == 1500 == len({r["booking_id"] for r in rows}) and all(r["same"] for r in rows)
