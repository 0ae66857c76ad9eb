"""Feature encoders and data splits as DataFrame jobs.

Learned lookup tables (country list, category codes, target statistics)
are aggregates with one row per category.  They are joined back by key.
Only tables with a proven bound (a top-k list, a checked category count)
are broadcast.  Larger ones go through a normal join, which AQE turns into a
broadcast when the measured size allows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_div, stable
from .prefix import global_running_sum, nested_running_sum, segmented_running_sum
from .quantiles import quantiles, value_block

Y = "is_canceled"


def left_lookup(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` left-joined to a per-key ``lookup`` table, with rows whose key
    is NULL kept out of the join (they cannot match).  In a shuffled join all
    NULL keys hash to one partition, and a missing category (no agent, no
    country) can be a third of the data; here those rows skip the shuffle.
    The join itself is left to AQE (broadcast when the lookup is small)."""
    has_key = None
    for k in keys:
        c = F.col(k).isNotNull()
        has_key = c if has_key is None else has_key & c
    extra = [c for c in lookup.columns if c not in keys]
    matched = df.filter(has_key).join(lookup, keys, "left")
    missing = df.filter(~has_key).select(
        *[F.col(c) for c in df.columns],
        *[F.lit(None).cast(lookup.schema[c].dataType).alias(c) for c in extra])
    return matched.unionByName(missing.select(*matched.columns))


# F01 + J01
def learn_top_countries(df: DataFrame, k: int = 36, col: str = "country") -> DataFrame:
    """The k most frequent values (ties: smaller value first); k rows."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(col).asc()).limit(k).select(col)


def lookup_country(df: DataFrame, top: DataFrame, col: str = "country",
                   out: str = "country_learned") -> DataFrame:
    """Left join to the learned list; unlisted or null -> 'Other'."""
    j = left_lookup(df, top.select(col, F.col(col).alias("_cv")), [col])
    return j.withColumn(out, F.coalesce(F.col("_cv"), F.lit("Other"))).drop("_cv")


# F02
def onehot(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per level (no level dropped).  ``levels`` come from the
    feature definition."""
    prefix = prefix or col
    return df.withColumns({f"{prefix}_{lv}": F.coalesce((F.col(col) == lv).cast("int"), F.lit(0))
                           for lv in levels})


# F03
def binary_codes(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """(value, code) with codes 1..n in value order, and the bit width
    ceil(log2(n+1)).  Ordering by value (not first appearance) is our
    choice: Spark has no defined row order to take 'first seen' from.  Codes
    are running counts over blocks of values, so any number of levels works."""
    d = df.filter(F.col(col).isNotNull()).select(col).distinct()
    kind = dict(d.dtypes)[col]
    block = F.substring(col, 1, 3) if kind == "string" else value_block(F.col(col).cast("double"))
    codes = global_running_sum(d, [F.col(col)], {"_block": block}, {"_code": F.lit(1).cast("long")}, exclusive=False, checkpoint=True)
    return codes, max(1, math.ceil(math.log2(codes.count() + 1)))


def binary_encode(df: DataFrame, col: str) -> DataFrame:
    codes, bits = binary_codes(df, col)
    j = left_lookup(df, codes, [col])
    code = F.coalesce(F.col("_code"), F.lit(0))
    return j.withColumns({f"{col}_{i}": F.shiftright(code, bits - 1 - i).bitwiseAND(1).cast("int")
                          for i in range(bits)}).drop("_code")


# F04
def target_stats(df: DataFrame, col: str, y: str = Y, by: Sequence[str] = ()) -> DataFrame:
    return (df.filter(F.col(y).isNotNull()).groupBy(col, *by)
            .agg(F.sum(y).cast("long").alias("_s"), F.count(y).alias("_n")))


def target_encode(df: DataFrame, col: str, y: str = Y, m: float = 10.0,
                  out: str | None = None) -> DataFrame:
    """m-estimate: (sum_y + m*prior) / (n + m), prior = overall label mean
    (the MLlib ``TargetEncoder`` smoothing form; m is our choice).  Null or
    unseen categories get the prior."""
    out = out or f"{col}_te"
    every = target_stats(df, col, y)                          # includes the null category
    prior = every.agg(F.sum("_s") / F.sum("_n")).scalar()
    j = left_lookup(df, every.filter(F.col(col).isNotNull()), [col])
    te = (F.col("_s") + F.lit(m) * prior) / (F.col("_n") + F.lit(m))
    return j.withColumn(out, F.coalesce(te, prior)).drop("_s", "_n")


def target_encode_oof(df: DataFrame, col: str, fold: str = "fold", y: str = Y, m: float = 10.0,
                      out: str | None = None) -> DataFrame:
    """Out-of-fold: each row is encoded with the statistics of the other
    folds: (category total) - (category, fold).  The prior is the
    out-of-fold label mean.  One aggregate pass over ``df`` by (category,
    fold), written as a small table; category totals and the few fold sums
    derive from it, and one join on the category brings them back."""
    out = out or f"{col}_te"
    from .learn import write_and_read
    per = write_and_read(target_stats(df, col, y, by=[fold]), "fold-stats")   # includes the null category
    sums = {r[fold]: (r["s"], r["n"]) for r in per.groupBy(fold).agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).collect()}
    all_s, all_n = (sum(v[i] for v in sums.values()) for i in (0, 1))
    cat = (per.filter(F.col(col).isNotNull()).groupBy(col)
           .agg(F.sum("_s").alias("_tot_s"), F.sum("_n").alias("_tot_n"),
                F.map_from_entries(F.collect_list(F.struct(fold, F.struct("_s", "_n")))).alias("_own")))
    j = left_lookup(df, cat, [col])
    prior = F.lit(None).cast("double")
    for f, (s_f, n_f) in sums.items():
        rest = (all_s - s_f) / (all_n - n_f) if all_n > n_f else None
        prior = F.when(F.col(fold).eqNullSafe(F.lit(f)), F.lit(rest).cast("double")).otherwise(prior)
    own = F.col("_own")[F.col(fold)]
    s = F.col("_tot_s") - F.coalesce(own["_s"], F.lit(0))
    n = F.col("_tot_n") - F.coalesce(own["_n"], F.lit(0))
    te = (s + F.lit(m) * prior) / (n + F.lit(m))
    return j.withColumn(out, F.coalesce(te, prior)).drop("_tot_s", "_tot_n", "_own")


def order_levels() -> dict[str, Column]:
    """Nested ranges of the hash ``_h`` in which a category's rows are ordered."""
    return {"_h20": F.shiftright("_h", 20), "_h10": F.shiftright("_h", 10)}


def target_encode_ordered(df: DataFrame, col: str, y: str = Y, m: float = 10.0, seed: int = 0,
                          key: str = "booking_id", out: str | None = None) -> DataFrame:
    """Ordered target statistics: a row's code is the m-estimate of the rows of
    its category that come earlier in a seeded order, so neither its own label
    nor a later one is in it.  The first row of a category and rows of the null
    category get the prior (the overall label mean); rows without a label get a
    code and count for none.

    The order is (Lehmer step of the key plus ``seed``, key).  Running sums are
    taken over nested hash ranges of each category, so a category with a third
    of all rows is many small windows (:func:`.prefix.nested_running_sum`)."""
    out = out or f"{col}_te"
    h = (F.col(key) % 2147483647 + seed) % 2147483647 * 48271 % 2147483647
    prior = df.agg(F.avg(y)).scalar()
    d = nested_running_sum(df.withColumn("_h", h), [col], [F.col("_h"), F.col(key)], order_levels(),
                           {"_s": F.coalesce(F.col(y), F.lit(0)).cast("long"), "_n": F.col(y).isNotNull().cast("long")})
    code = (F.col("_s") + F.lit(m) * prior) / (F.col("_n") + F.lit(m))
    return d.withColumn(out, F.when(F.col(col).isNull(), prior).otherwise(code)).drop("_h", "_s", "_n")


# F05
def log_robust_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_rs") -> DataFrame:
    """log1p, then (v - median) / (Q3 - Q1) with exact, distributed quartiles
    (:mod:`.quantiles`)."""
    q = quantiles(df, {c: F.log1p(F.col(c)) for c in cols}, [0.25, 0.5, 0.75])
    q = q.agg(F.map_from_entries(F.collect_list(F.struct("column", "q")))).scalar()
    outs = {}
    for c in cols:
        qc = q[c]
        outs[c + suffix] = robust_scaled(F.log1p(F.col(c)), qc)
    return df.withColumns(outs)


def robust_scaled(x: Column, quartiles) -> Column:
    """(x - median) / (Q3 - Q1); null where the quartiles are equal."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    q1, median, q3 = (lit(quartiles[i]) for i in range(3))
    return stable(safe_div(x - median, q3 - q1))


# F06
def class_weights(df: DataFrame, y: str = Y) -> DataFrame:
    """Balanced weights n / (k * n_c) per label value."""
    g = df.filter(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = df.filter(F.col(y).isNotNull()).agg(F.count(F.lit(1))).scalar()
    k = g.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("weight", total / (k * F.col("n")))


def with_class_weight(df: DataFrame, y: str = Y, out: str = "weight") -> DataFrame:
    w = class_weights(df, y).select(y, F.col("weight").alias(out))
    return df.join(F.broadcast(w), y, "left")  # one row per label value


# F07 / F08
def portable_hash(key: str = "booking_id") -> Column:
    """A repeatable shuffle key that SQL engines can also compute:
    Lehmer step ((k mod M) * 48271) mod M with M = 2^31 - 1."""
    return (F.col(key) % 2147483647) * 48271 % 2147483647


def stratified_rank(df: DataFrame, y: str = Y, key: str = "booking_id") -> DataFrame:
    """Row number within each label value, ordered by (portable hash, key).

    A label value holds about half the rows, so a plain window would run in
    two tasks; the running count is split into 2^20 hash blocks per label
    (about 500k rows per block at 10^12 rows; the offsets table is at most
    2^20 small rows per label).
    """
    d = df.withColumn("_h", portable_hash(key))
    out = segmented_running_sum(d, segment=[y], order=[F.col("_h"), F.col(key)],
                                split={"_hblk": F.shiftright(F.col("_h"), 11)},
                                values={"_rn": F.lit(1)}, exclusive=False)
    return out.drop("_h")


def stratified_split(df: DataFrame, test_fraction: float = 0.2, y: str = Y,
                     key: str = "booking_id") -> DataFrame:
    """Add ``split`` ('train'/'test'): per label value, the first
    floor(n_c * f + 0.5) rows in hash order are test.  Same share of each
    label in both parts; repeatable on recompute."""
    r = stratified_rank(df, y, key)
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    r = r.join(F.broadcast(n), y, "left")  # one row per label value
    cut = F.floor(F.col("_nc") * test_fraction + 0.5)
    return r.withColumn("split", F.when(F.col("_rn") <= cut, "test").otherwise("train")).drop("_rn", "_nc")


def stratified_folds(df: DataFrame, k: int = 5, y: str = Y, key: str = "booking_id") -> DataFrame:
    """Add ``fold`` 1..k dealt round-robin in hash order within each label
    value: fold sizes per label differ by at most one."""
    r = stratified_rank(df, y, key)
    return r.withColumn("fold", (((F.col("_rn") - 1) % k) + 1).cast("int")).drop("_rn")
