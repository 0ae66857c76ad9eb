"""Edge cases S3-S18 on tiny frames, against pandas/NumPy versions of the
reference's batch rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrisk.constants import COUNTRIES, MONTHS
from stayrisk.functions import features as fx


def col(spark, name, values, dtype):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {dtype}")


def collect(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


def test_lead_bins_right_closed(spark):
    vals = [-1, 0, 7, 8, 30, 31, 90, 91, 180, 181, 709, 710, None]
    d = col(spark, "lead_time", vals, "int").select("i", fx.lead_bin().alias("b"), fx.lead_bin_no().alias("n"))
    labels = ["0–7", "8–30", "31–90", "91–180", "181+"]
    expect = pd.cut(pd.Series(vals, dtype="float"), bins=[-1, 7, 30, 90, 180, 709], labels=labels)
    got = collect(d, "b")
    assert got == [None if pd.isna(e) else str(e) for e in expect]
    assert collect(d, "n")[1] == 1 and collect(d, "n")[10] == 5 and collect(d, "n")[11] is None


def test_risk_label_decision_gauge_grade(spark):
    ps = [0.0, 0.39, 0.40, 0.4001, 0.5999, 0.60, 0.65, 0.6501, 0.75, 1.0, None]
    d = col(spark, "p", ps, "double")
    d = d.select("i", "p", fx.risk_label("p").alias("lab"), fx.decision("p").alias("pred"),
                 fx.gauge_band("p").alias("g"))
    d = d.withColumn("grade", fx.risk_grade("p", "pred"))
    expect = pd.cut(pd.Series(ps, dtype="float"), bins=[-0.01, 0.40, 0.65, 1.01], labels=["low", "medium", "high"])
    assert collect(d, "lab") == [None if pd.isna(e) else str(e) for e in expect]
    assert collect(d, "pred")[:10] == [int(p >= 0.60) for p in ps[:10]]
    assert collect(d, "g")[:10] == ["green", "green", "amber", "amber", "amber", "amber", "red", "red", "red", "red"]
    assert collect(d, "grade")[:10] == ["low", "low", "medium", "medium", "medium", "high", "high", "high",
                                        "very_high", "very_high"]


def test_prob_round_is_numpy_half_even(spark):
    ps = [0.12345, 0.00005, 0.00015, 0.5, 0.99995, 0.33335, 0.123449999]
    d = col(spark, "p", ps, "double").select("i", fx.prob_round("p").alias("r"))
    assert collect(d, "r") == [float(np.round(p, 4)) for p in ps]


def _pandas_bins(v):
    n = int(v) if pd.notna(v) else 0
    return ("never" if n == 0 else "once" if n == 1 else "multiple",
            "none" if n == 0 else "some" if n <= 3 else "many",
            "none" if n == 0 else "some" if n <= 2 else "many")


def test_count_bins_truncate_and_fall_through(spark):
    vals = [None, -1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 4.0]
    d = col(spark, "x", vals, "double").select(
        "i", fx.prev_cancel_bin("x").alias("a"), fx.prev_loyal_bin("x").alias("b"),
        fx.booking_changes_bin("x").alias("c"), fx.babies_bin("x").alias("bb"),
        fx.parking_bin("x").alias("pk"), fx.children_bin("x").alias("ch"))
    exp = [_pandas_bins(v) for v in vals]
    assert list(zip(collect(d, "a"), collect(d, "b"), collect(d, "c"))) == exp
    assert collect(d, "bb")[3] == "no_baby" and collect(d, "pk")[3] == "no_parking"
    assert collect(d, "ch")[0] == "no_children"


def test_no_commitment_compares_raw_value(spark):
    d = spark.createDataFrame([(0, 0.5, 0), (1, 0.0, 0), (2, None, None), (3, 0.0, 2)],
                              "i int, required_car_parking_spaces double, total_of_special_requests int")
    d = d.select("i", fx.no_commitment().alias("nc"), fx.parking_bin().alias("pb"))
    assert collect(d, "nc") == [0, 1, 1, 0]
    assert collect(d, "pb")[0] == "no_parking"


def test_month_number_season_cyclic(spark):
    names = MONTHS + ["Foo", None]
    d = col(spark, "arrival_date_month", names, "string")
    m = fx.month_number()
    d = d.select("i", m.alias("m"), fx.month_number(default=None).alias("m0"),
                 fx.arrival_season(m).alias("s"), fx.month_sin(m).alias("sn"), fx.month_cos(m).alias("cs"))
    assert collect(d, "m") == list(range(1, 13)) + [1, 1]
    assert collect(d, "m0")[12:] == [None, None]
    assert collect(d, "s")[11] == "Winter" and collect(d, "s")[12] == "Winter" and collect(d, "s")[6] == "Summer"
    for i, (sn, cs) in enumerate(zip(collect(d, "sn"), collect(d, "cs"))):
        mm = (i + 1) if i < 12 else 1
        assert math.isclose(sn, math.sin(2 * math.pi * mm / 12), abs_tol=1e-15)
        assert math.isclose(cs, math.cos(2 * math.pi * mm / 12), abs_tol=1e-15)


def test_sentinel_ids_from_text(spark):
    vals = ["0", "7", "NULL", "abc", "", None, "12.0"]
    d = col(spark, "agent", vals, "string").select("i", fx.sentinel_id("agent", "string").alias("a"))
    expect = pd.to_numeric(pd.Series(vals), errors="coerce").replace(0, np.nan)
    assert collect(d, "a") == [None if pd.isna(e) else float(e) for e in expect]


def test_country_grouped(spark):
    vals = ["PRT", "Other", "XYZ", None, "USA"]
    d = col(spark, "country", vals, "string").select("i", fx.country_grouped().alias("c"))
    assert collect(d, "c") == [v if v in COUNTRIES else "Other" for v in vals]


def test_lead_x_transient_and_weekend(spark):
    d = spark.createDataFrame([(0, None, "Transient", 0, 2), (1, 10, None, 1, 0), (2, 10, "Transient", None, 1)],
                              "i int, lead_time int, customer_type string, stays_in_week_nights int, stays_in_weekend_nights int")
    d = d.select("i", fx.lead_x_transient().alias("x"), fx.is_weekend_only().alias("w"))
    assert collect(d, "x") == [0, 0, 10]
    assert collect(d, "w") == [1, 0, 1]


def test_feature_matrix_contract(spark, sf):
    from stayrisk.sources.bookings import bookings
    from stayrisk.constants import FEATURE_COLUMNS
    b = bookings(spark, sf)
    fm = fx.feature_matrix(b)
    assert fm.columns == ["booking_id"] + FEATURE_COLUMNS
    with pytest.raises(ValueError):
        fx.feature_matrix(b.drop("lead_time"))
    with pytest.raises(ValueError):
        fx.feature_matrix(b.drop("meal"))
    filled = fx.feature_matrix(b.drop("meal", "company"), fill_missing=True)
    r = filled.select(F.max("meal").alias("m"), F.count("company").alias("c")).first()
    assert r["m"] == 0 and r["c"] == 0
    g = fx.feature_matrix(b.withColumn("country_grouped", F.lit("ZZZ")), validate_grouped=True)
    assert g.select("country_grouped").distinct().collect()[0][0] == "Other"
