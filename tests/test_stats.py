"""Dashboard reports on small fixtures: ties, support cut, null keys, grid,
RevPAR with a capacity table."""

import pytest
from pyspark.sql import functions as F

from stayrisk.operators import explain as ex
from stayrisk.operators import stats as st


def test_top10_ties_and_support_cut(spark):
    # 11 countries with 200 rows and equal rates, one with 199 rows and a higher rate
    rows = []
    names = [f"C{i:02d}" for i in range(11)]
    for c in names:
        rows += [(c, 1 if i < 50 else 0, "City Hotel") for i in range(200)]
    rows += [("AAA", 1, "City Hotel") for _ in range(199)]
    rows += [(None, 1, "City Hotel") for _ in range(500)]
    df = spark.createDataFrame(rows, "country string, is_canceled int, hotel string")
    top = st.country_top10(df).orderBy("rank").collect()
    assert [r["country"] for r in top] == names[:10]          # group-key order on ties; AAA cut by n >= 200
    assert all(r["n"] == 200 and r["cr"] == 25.0 for r in top)
    assert [r["rank"] for r in top] == list(range(1, 11))


def test_null_keys_dropped_and_labels_counted(spark):
    df = spark.createDataFrame([("A", 1), ("A", None), (None, 1), ("B", 0)], "hotel string, is_canceled int")
    r = {x["hotel"]: x for x in st.hotel_stats(df).collect()}
    assert set(r) == {"A", "B"}
    assert r["A"]["total"] == 1 and r["A"]["cr"] == 100.0          # mean and count skip the null label
    h = st.headline(df).first()
    assert h["total"] == 4                                          # total counts rows


def test_complete_grid_keeps_empty_bins(spark):
    df = spark.createDataFrame([(5, "City Hotel", 1), (800, "Resort Hotel", 0), (100, "City Hotel", 0)],
                               "lead_time int, hotel string, is_canceled int")
    g = st.lead_hotel_rate(df, complete=True).collect()
    assert len(g) == 10
    resort = [r for r in g if r["hotel"] == "Resort Hotel"]
    assert all(r["n"] == 0 and r["cr"] is None for r in resort)    # 800 is outside the bins
    obs = st.lead_hotel_rate(df, complete=False).collect()
    assert len(obs) == 2


def test_month_order_and_unknown(spark):
    df = spark.createDataFrame([("March", 1), ("Foo", 0), ("January", 1)], "arrival_date_month string, is_canceled int")
    r = st.month_rate(df).orderBy(F.col("month_num").asc_nulls_last()).collect()
    assert [x["arrival_date_month"] for x in r] == ["January", "March", "Foo"]
    assert r[2]["month_num"] is None


def test_revpar_with_capacity(spark):
    df = spark.createDataFrame([("City Hotel", 0, 100.10, 1, 2), ("City Hotel", 1, 500.0, 3, 3),
                                ("Resort Hotel", 0, 80.05, 0, 1)],
                               "hotel string, is_canceled int, adr double, stays_in_weekend_nights int, stays_in_week_nights int")
    cap = spark.createDataFrame([("City Hotel", 10, 30), ("Resort Hotel", 5, 30)], "hotel string, rooms long, days long")
    r = {x["hotel"]: x for x in st.revpar(df, cap).collect()}
    assert r["City Hotel"]["revenue"] == pytest.approx(300.30) and r["City Hotel"]["kept"] == 1
    assert r["City Hotel"]["revpar"] == pytest.approx(300.30 / 300)
    assert r["Resort Hotel"]["revenue"] == pytest.approx(80.05)


def test_attribution_threshold_and_abs_ties(spark):
    df = spark.createDataFrame([(1, 0.0001, -0.0001, 0.00011, 0.5, -0.5, 0.0)],
                               "booking_id long, a double, b double, c double, d double, e double, f double")
    r = ex._ranked_long(df, "booking_id", [(c, F.col(c)) for c in "abcdef"])
    ranks = {x["feature"]: x["rank"] for x in r.collect()}
    assert ranks["d"] == 1 and ranks["e"] == 2                      # equal |shap|: feature name order
    kept = sorted(x["feature"] for x in ex.positive_attributions(r).collect())
    assert kept == ["c", "d", "e"]                                  # |0.0001| is not > 0.0001
    assert ex.top_attributions(r, 3).count() == 3


def test_profiles_hold_no_column_in_one_task(spark):
    from stayrisk.operators import quality as ql
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "lead_time int, is_canceled int")
    for d in (ql.numeric_profile(df, ["lead_time"]), ql.outlier_profile(df, ["lead_time"])):
        assert "percentile" not in d._jdf.queryExecution().executedPlan().toString()
    assert ql.numeric_profile(df, ["lead_time"]).first()["median"] == 49.5
    assert [r["n"] for r in st.bivariate_rate(df, "lead_time").orderBy("bin").collect()] == [25, 25, 25, 25]
