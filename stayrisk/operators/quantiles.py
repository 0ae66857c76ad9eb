"""Exact quantiles by multi-pass selection.

No task holds a column's values, nothing is sorted and no table of distinct
values is made: each pass counts values per bucket for all columns, groups and
ranks at once, and the buckets that hold a wanted rank are cut finer in the next
pass.  A column of a few thousand different values takes two passes, any
column of doubles about six.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS_PER_OCTAVE = 4096
STEPS_PER_OCTAVE = 64
PARTS = 4096


def value_block(x: Column) -> Column:
    """A block number that never decreases with ``x``: equal steps of log2(1 + |x|)."""
    return F.signum(x) * F.floor(F.log2(F.abs(x) + 1.0) * BLOCKS_PER_OCTAVE)


def log_bucket(x: Column) -> Column:
    """A bucket number that never decreases with ``x``: 64 to an octave of |x|,
    for any size of value; 0 for zero."""
    step = F.floor(F.log2(F.abs(x)) * STEPS_PER_OCTAVE) + F.lit(STEPS_PER_OCTAVE * 1100)
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, step).otherwise(-step)


def long_values(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``*by, column, value`` (double): one row per value that is neither null nor NaN."""
    entries = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.cast("double").alias("value")) for c, v in columns.items()]))
    # -0.0 and 0.0 are one value
    return (df.select(*by, entries).filter(F.col("value").isNotNull() & ~F.isnan("value"))
            .withColumn("value", F.col("value") + 0.0))


def bucket_counts(values: DataFrame, by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """First pass over ``long_values``: rows, least and greatest value (and
    ``extra`` aggregates) per column, group and :func:`log_bucket`."""
    return values.groupBy(*by, "column", log_bucket(F.col("value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), *extra)


def _held(buckets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bucket that holds each wanted rank.  ``buckets``: ``_key, from, bucket,
    n, lo, hi``; ``wanted``: ``_key, from, rank, skip`` (rows below the interval
    that begins at ``from``).  The window runs over one interval's buckets."""
    w = Window.partitionBy("_key", "from").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    t = wanted.select(F.col("_key").alias("_k"), F.col("from").alias("_f"), "rank", "skip")
    at = F.col("rank") - F.col("skip")
    return (b.join(t, (b["_key"] == t["_k"]) & b["from"].eqNullSafe(t["_f"]) & (F.col("before") <= at) & (at < F.col("before") + F.col("n")))
            .select("_key", "rank", (F.col("skip") + F.col("before")).alias("skip"), "lo", "hi"))


def selected(values: DataFrame, buckets: DataFrame, ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``_key, rank, value``: the value of each wanted rank (``ranks``: ``_key,
    rank``, rank 0 the least) by repeated selection.

    Every pass counts, for all columns, groups and ranks at once, the values of
    the intervals that still hold a wanted rank, in 4,096 parts of each, and
    keeps the part that holds the rank, narrowed to its least and greatest
    value; a rank is found when both are one.  Nothing is sorted, no distinct
    values are kept and a pass's output is bounded by 4,096 rows per rank."""
    keys = F.struct(*by, "column")
    start = F.lit(None).cast("double")
    state = _saved(_held(buckets.select(keys.alias("_key"), start.alias("from"), "bucket", "n", "lo", "hi"),
                         ranks.select("_key", start.alias("from"), "rank", F.lit(0).cast("long").alias("skip"))))
    found = state.filter("lo = hi")
    left = state.filter("lo < hi")
    v = values.select(keys.alias("_key"), "value")
    while left.count():
        spans = left.select(F.col("_key").alias("_k"), "lo", "hi").distinct()
        inside = v.join(spans, (v["_key"] == spans["_k"]) & (v["value"] >= spans["lo"]) & (v["value"] <= spans["hi"]))
        shrink = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e300, 0.25).otherwise(1.0)  # hi - lo stays finite
        part = F.floor((F.col("value") * shrink - F.col("lo") * shrink) / (F.col("hi") * shrink - F.col("lo") * shrink) * PARTS)
        b = inside.groupBy("_key", F.col("lo").alias("from"), F.least(part, F.lit(PARTS - 1)).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        state = _saved(_held(b, left.select("_key", F.col("lo").alias("from"), "rank", "skip")))
        found, left = found.unionByName(state.filter("lo = hi")), state.filter("lo < hi")
    return found.select("_key", "rank", F.col("lo").alias("value"))


def _saved(df: DataFrame) -> DataFrame:
    from .learn import write_and_read
    return write_and_read(df.coalesce(1), "selection")  # a row per rank that is wanted


def quantiles_of(values: DataFrame, buckets: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``*by, column, n, q`` (array, one entry per probability), linearly
    interpolated between ranks.  ``buckets`` are those of :func:`bucket_counts`."""
    total = buckets.groupBy(F.struct(*by, "column").alias("_key")).agg(F.sum("n").alias("total"))
    p = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("p")) for i, x in enumerate(probs)]))
    want = total.select("_key", "total", p.alias("w")).select("_key", "total", "w.i", (F.col("w.p") * (F.col("total") - 1)).alias("at"))
    sides = F.explode(F.array(F.floor("at"), F.ceil("at")))
    ranks = want.select("_key", sides.alias("rank")).distinct()
    found = selected(values, buckets, ranks, by)
    f = found.select(F.col("_key").alias("_k"), "rank", "value")
    pair = (want.join(f, (want["_key"] == f["_k"]) & f["rank"].isin(F.floor(want["at"]), F.ceil(want["at"])))
            .groupBy("_key", "i", "at", "total").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        (F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    done = pair.groupBy("_key").agg(F.first("total").alias("n"), F.sort_array(F.collect_list(F.struct("i", q.alias("q")))).alias("all"))
    return done.select("_key.*", "n", F.col("all.q").alias("q"))


def quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of ``columns`` per group: ``*by, column, n, q``."""
    values = long_values(df, columns, by)
    return quantiles_of(values, _saved(bucket_counts(values, by)), probs, by)
