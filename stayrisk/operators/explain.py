"""Attributions: linear (G16), ranking and filtering per booking (W01-W03,
B05), tree importances (G13, W04), TreeSHAP (G14, G15).

Per-booking ranking is done on the booking's own attribution array, a narrow
projection, so ranking adds no shuffle however many bookings there are.  A few named
columns are sorted as structs (``sort_array``); an array with a slot per feature of a
model is ranked batch by batch in numpy, which gives the places in rank order, since
Spark compares structs one field after another by an interpreter.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# functions that run in tasks travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_ABS = 0.0001

# Example coefficients on count-like features, for the query that has a SQL
# twin; those of a fitted model come from ``learn.linear_weights``.
LINEAR_WEIGHTS = {
    "lead_time": 0.004, "stays_in_weekend_nights": 0.05, "stays_in_week_nights": 0.03,
    "adults": 0.1, "is_repeated_guest": -0.6, "days_in_waiting_list": 0.002,
    "total_of_special_requests": -0.5, "no_commitment": 0.8, "lead_x_transient": 0.002,
    "is_weekend_only": -0.2, "previous_cancellations": 0.9, "booking_changes": -0.3,
    "required_car_parking_spaces": -2.0,
}


def _ranking(entries) -> Column:
    """An array of (none, k, feature, shap) structs in rank order: rank 1 =
    largest |shap|, ties by feature name, an attribution that is null after all
    others.  An entry's rank is its place."""
    return F.sort_array(entries)


def _ranked_rows(d: DataFrame, key: str) -> DataFrame:
    """Rank, size and direction of rows ``key, feature, shap, pos``."""
    return d.select(key, "feature", "shap", F.abs("shap").alias("abs_shap"), (F.col("pos") + 1).cast("long").alias("rank"),
                    F.when(F.col("shap") > 0, "raises").when(F.col("shap").isNotNull(), "lowers").alias("direction"))


def _ranked_entries(df: DataFrame, key: str, entries) -> DataFrame:
    """One row per (key, feature) of :func:`_ranking`."""
    d = df.select(key, F.posexplode(_ranking(entries)).alias("pos", "e"))
    return _ranked_rows(d.select(key, F.col("e.feature").alias("feature"), F.col("e.shap").alias("shap"), "pos"), key)


def _entry(feature, v):
    return F.struct(v.isNull().alias("none"), (-F.abs(v)).alias("k"), feature.alias("feature"), v.alias("shap"))


def _ranked_long(df: DataFrame, key: str, entries: list) -> DataFrame:
    """Ranked rows from a list of (feature name, shap Column)."""
    return _ranked_entries(df, key, F.array(*[_entry(F.lit(f), v) for f, v in entries]))


# G16 + W01
def linear_attribution(df: DataFrame, weights: dict[str, float] = LINEAR_WEIGHTS,
                       key: str = "booking_id") -> DataFrame:
    """Exact attribution of a linear (logit) model: w * (x - mean x), ranked
    within each booking.  Means are one aggregate, read as one scalar subquery."""
    feats = list(weights)
    # one aggregate for all means, read through a single scalar subquery
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in feats]).alias("m")).scalar()
    entries = [(f, F.lit(float(w)) * (F.col(f) - means[f])) for f, w in weights.items()]
    return _ranked_long(df, key, entries)


# W02 / W03
def top_attributions(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


# B05 (rank is counted before the drop)
def positive_attributions(ranked: DataFrame, min_abs: float = MIN_ABS) -> DataFrame:
    return ranked.filter(F.col("abs_shap") > min_abs)


# W04
def importance_topk(importance: DataFrame, k: int = 10) -> DataFrame:
    """(feature, share) -> k largest with rank; the table has one row per
    feature, so the un-partitioned window is bounded by the feature count."""
    w = Window.orderBy(F.col("share").desc(), F.col("feature").asc())
    return importance.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def mean_abs_attribution(long: DataFrame) -> DataFrame:
    """G15 aggregate: mean |shap| per feature (partial aggregation, one row
    per feature per task)."""
    return long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"),
                                       F.count(F.lit(1)).alias("n"))


def feature_names(df: DataFrame, features_col: str) -> list[str]:
    """Slot names of an assembled vector column from its ML attribute metadata."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    names = {}
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a["name"]
    n = meta.get("num_attrs", len(names))
    return [names.get(i, f"f{i}") for i in range(n)]


def places_in_rank_order(shap: pa.Array, names: Sequence[str]) -> pa.Array:
    """Of each row's attributions the places in rank order: largest size first, ties
    by feature name, NaN after all others and null after NaN (as :func:`_ranking`)."""
    n, whole = len(names), shap.flatten()
    # places by name; an attribution without a name stands before all names
    by_name = lambda k: sorted(range(k), key=lambda i: (i < n, names[i].encode() if i < n else b""))
    if shap.null_count or len(set(names)) < n or len(whole) != n * len(shap) or not (np.diff(shap.offsets.to_numpy()) == n).all():
        low = lambda v: (v is None, v != v, -abs(v) if v is not None and v == v else 0.0)
        sign = lambda v: v if v is not None and v == v else 0.0
        name = lambda i: (i < n, names[i].encode() if i < n else b"")
        return pa.array([None if row is None else sorted(range(len(row)), key=lambda i: (low(row[i]), name(i), sign(row[i]))) for row in shap.to_pylist()], pa.list_(pa.int32()))
    order = np.array(by_name(n), np.int32)
    v = whole.to_numpy(zero_copy_only=False).reshape(-1, n)[:, order]
    at = np.argsort(-np.abs(v), axis=1, kind="stable")
    if whole.null_count:
        none = whole.is_null().to_numpy(zero_copy_only=False).reshape(-1, n)[:, order]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(none, at, axis=1), axis=1, kind="stable"), axis=1)
    return pa.ListArray.from_arrays(np.arange(0, v.size + 1, n, dtype=np.int32), order[at].ravel())


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _ranked_from_arrays(df: DataFrame, key: str, names: Sequence[str], shap_col: str) -> DataFrame:
    """Ranked rows from one array of attributions, in the order of ``names``.  Arrays and
    places come out of one step, which the optimizer does not look into: it would put
    the attributions' expressions wherever they are read."""
    names, kind = list(names), df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), places_in_rank_order(b.column(1), names)], names=[key, "_shap", "_at"])

    d = df.select(key, F.col(shap_col).cast("array<double>").alias("_shap")).mapInArrow(run, f"`{key}` {kind}, _shap array<double>, _at array<int>")
    d = d.select(key, "_shap", F.posexplode("_at").alias("pos", "_i"))
    d = d.select(key, F.get(_names(names), F.col("_i")).alias("feature"), F.get("_shap", F.col("_i")).alias("shap"), "pos")
    return _ranked_rows(d, key)


def ranking_of_arrays(names: Sequence[str], shap_col: str) -> Column:
    """What :func:`_ranked_from_arrays` makes rows of, as one array a booking:
    (rank, feature, shap) structs.  Sums and checks within a booking read this
    and need no shuffle."""
    names = list(names)

    def run(shap: pa.Array) -> pa.Array:
        at = places_in_rank_order(shap, names)
        begin = np.repeat(shap.offsets.to_numpy()[:-1], np.diff(at.offsets.to_numpy()))
        values = pa.concat_arrays([shap.values]).take(pa.array(begin + at.values.to_numpy()))
        return pa.ListArray.from_arrays(at.offsets, pa.StructArray.from_arrays([at.values, values], names=["at", "shap"]), mask=shap.is_null() if shap.null_count else None)

    ranked = F.arrow_udf(run, "array<struct<at: int, shap: double>>")(F.col(shap_col).cast("array<double>"))
    name = _names(names)
    return F.transform(ranked, lambda e, i: F.struct((i + 1).cast("long").alias("rank"), F.get(name, e["at"]).alias("feature"), e["shap"].alias("shap")))


def vector_shap(df: DataFrame, weights: Sequence[float], features_col: str = "features",
                key: str = "booking_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, shap array): w * (x - mean x) per slot of an assembled vector
    column.  Means are one aggregate of one value per slot."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    mean = df.select(Summarizer.mean(F.col(features_col))).first()[0].toArray()
    w, m = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (weights, mean))
    shap = F.transform("x", lambda v, i: F.get(w, i) * (v - F.get(m, i)))
    return df.select(key, *keep, vector_to_array(features_col).alias("x")).select(key, *keep, shap.alias("shap"))


def vector_attribution(df: DataFrame, weights: Sequence[float], names: Sequence[str],
                       features_col: str = "features", key: str = "booking_id") -> DataFrame:
    """G16 of a fitted linear model over an assembled vector column, ranked
    within each booking."""
    return _ranked_from_arrays(vector_shap(df, weights, features_col, key), key, names, "shap")
