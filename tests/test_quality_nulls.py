"""Profiles and correlations on columns with nulls equal pandas' pairwise ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrisk.operators import explain as ex
from stayrisk.operators import quality as ql
from stayrisk.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.default_rng(4)
    p = pd.DataFrame({"a": rnd.integers(-50, 900, 400).astype(float), "b": rnd.integers(0, 5, 400).astype(float),
                      "adr": (rnd.integers(0, 52000, 400) / 100), "c": rnd.normal(size=400)})
    for col, step in (("a", 3), ("b", 4), ("adr", 7), ("c", 9)):
        p.loc[::step, col] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "a double, b double, adr double, c double")
    return p, df.withColumns({"a": F.col("a").cast("int"), "b": F.col("b").cast("int")})


def test_correlation_is_pairwise(frame):
    p, df = frame
    got = {(r["col_a"], r["col_b"]): r["r"] for r in ql.correlation(df, ["a", "b", "adr", "c"]).collect()}
    want = p.corr()
    assert len(got) == 6
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-8)


def test_profiles_match_pandas(frame):
    p, df = frame
    got = {r["column"]: r for r in ql.numeric_profile(df, ["a", "b", "adr"]).collect()}
    fences = {r["column"]: r for r in ql.outlier_profile(df, ["a", "b", "adr"]).collect()}
    for c in ("a", "b", "adr"):
        v = p[c].dropna()
        g = got[c]
        assert g["n"] == len(v) and g["mean"] == pytest.approx(v.mean()) and g["sd"] == pytest.approx(v.std(), abs=1e-6)
        q1, q2, q3 = v.quantile([0.25, 0.5, 0.75])
        assert (g["q1"], g["median"], g["q3"]) == pytest.approx((q1, q2, q3))
        assert g["zero_share"] == pytest.approx((v == 0).mean())
        assert fences[c]["n_above"] == (v > q3 + 1.5 * (q3 - q1)).sum() and fences[c]["n_below"] == (v < q1 - 1.5 * (q3 - q1)).sum()


def test_empty_column_keeps_its_row(spark):
    df = spark.createDataFrame([(None, 1)], "a int, b int")
    r = {x["column"]: x for x in ql.numeric_profile(df, ["a", "b"]).collect()}
    assert r["a"]["n"] == 0 and r["a"]["median"] is None and r["b"]["median"] == 1.0
    assert {x["column"]: x["n_above"] for x in ql.outlier_profile(df, ["a", "b"]).collect()} == {"a": 0, "b": 0}
    assert [x["r"] for x in ql.correlation(df, ["a", "b"]).collect()] == [None]


def test_quantiles_by_group_without_percentile(spark):
    rows = [(g, float(v)) for g, n in (("x", 101), ("y", 4), (None, 3)) for v in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = quantiles(df, {"v": F.col("v")}, [0.0, 0.25, 1.0], ["g"])
    assert {r["g"]: r["q"] for r in q.collect()} == {"x": [0.0, 25.0, 100.0], "y": [0.0, 0.75, 3.0], None: [0.0, 0.5, 2.0]}
    assert "percentile" not in q._jdf.queryExecution().executedPlan().toString()


def test_null_attribution_ranks_last(spark):
    df = spark.createDataFrame([(1, None, -0.5, 0.2)], "booking_id long, a double, b double, c double")
    r = {x["feature"]: x for x in ex._ranked_long(df, "booking_id", [(c, F.col(c)) for c in "abc"]).collect()}
    assert [r[f]["rank"] for f in "bca"] == [1, 2, 3] and r["a"]["direction"] is None


@pytest.mark.parametrize("scale", [1.0, 1e15, 1e-9, 1e300, 3.7])
def test_selection_equals_sorting(spark, scale):
    """Quantiles of columns of any magnitude, heavy ties and both signs."""
    rnd = np.random.default_rng(8)
    p = pd.DataFrame({"u": rnd.normal(size=700) * scale, "w": np.round(rnd.exponential(3, 700)) * scale,
                      "mixed": np.where(rnd.random(700) < 0.5, rnd.normal(size=700) * 1e-9, rnd.normal(size=700) * 1e12),
                      "g": rnd.integers(0, 3, 700)})
    df = spark.createDataFrame(p).repartition(5)
    cols, probs = ["u", "w", "mixed"], [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, {c: F.col(c) for c in cols}, probs, ["g"]).collect()
    assert len(got) == 9
    for r in got:
        v = p.loc[p.g == r["g"], r["column"]]
        assert r["n"] == len(v)
        for a, q in zip(r["q"], probs):
            lo, hi = v.quantile(q, interpolation="lower"), v.quantile(q, interpolation="higher")
            assert a == pytest.approx(v.quantile(q), rel=1e-12, abs=0) or lo <= a <= hi


def test_moments_of_huge_and_tiny_values(spark):
    import fractions
    import statistics
    big = [10**11 + i * 7 for i in range(50)] + [10**15, -10**15, 4_000_000_000]
    df = spark.createDataFrame([(b, float(b) * 1e-24, float(b)) for b in big], "whole long, tiny double, whole_d double")
    r = {x["column"]: x for x in ql.numeric_profile(df, ["whole", "tiny", "whole_d"]).collect()}
    want = float(statistics.stdev([fractions.Fraction(b) for b in big]))
    for c in ("whole", "whole_d"):
        assert r[c]["sd"] == pytest.approx(want, rel=1e-15) and r[c]["mean"] == sum(big) / len(big)
        assert (r[c]["min"], r[c]["median"], r[c]["max"]) == (-10**15, statistics.median(big), 10**15)
    assert r["tiny"]["sd"] == pytest.approx(want * 1e-24, rel=1e-12) and r["tiny"]["max"] == pytest.approx(1e-9)
    assert [x["n_above"] for x in ql.outlier_profile(df, ["whole", "tiny"]).collect()] == [1, 1]


def test_correlation_of_huge_integers_and_masks(spark):
    rnd = np.random.default_rng(2)
    p = pd.DataFrame({"a": rnd.integers(0, 4 * 10**9, 300).astype(float), "d": rnd.integers(-10**18, 10**18, 300).astype(float)})
    p["b"] = p.a * 2 + rnd.integers(0, 10**9, 300)
    p["k"] = 5.0
    for i, c in enumerate(("a", "b", "d")):
        p.loc[i::4, c] = np.nan
    rows = [tuple(None if np.isnan(v) else int(v) for v in r) for r in p[["a", "b", "d", "k"]].values]
    df = spark.createDataFrame(rows, "a long, b long, d long, k int")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in ql.correlation(df, ["a", "b", "d", "k"]).collect()}
    for (x, y), v in got.items():
        assert v is None if "k" in (x, y) else v == pytest.approx(p[x].corr(p[y]), abs=1e-8)
    many = df.crossJoin(spark.range(200))  # d * d beyond 38 digits
    again = {(r["col_a"], r["col_b"]): r["r"] for r in ql.correlation(many, ["a", "b", "d"]).collect()}
    assert again["a", "d"] == pytest.approx(got["a", "d"], abs=1e-8) and again["a", "b"] == got["a", "b"]
    plan = ql.mask_sums(df, ["a", "b", "d", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
