"""Data-quality and profiling jobs.

Column-wise profiles run as *one* aggregate pass over the table (one
``count_if`` per column), then ``stack`` turns the
single wide row into a long (column, ...) table.  Value profiles
``stack`` the columns into (column, value) pairs first and aggregate once;
the map-side partial aggregate keeps the shuffle at one row per distinct
pair per task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORY_DOMAINS, COUNTRIES, MIN_SUPPORT, NUMERIC_DOMAINS
from ..functions.numeric import cents
from .quantiles import bucket_counts, long_values, quantiles, quantiles_of

LABEL = "is_canceled"

NUMERIC_PROFILE_COLUMNS = [
    "lead_time", "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children",
    "babies", "is_repeated_guest", "previous_cancellations", "previous_bookings_not_canceled",
    "booking_changes", "agent", "company", "days_in_waiting_list", "adr",
    "required_car_parking_spaces", "total_of_special_requests",
]
CATEGORY_PROFILE_COLUMNS = [
    "hotel", "arrival_date_month", "meal", "country", "market_segment",
    "distribution_channel", "reserved_room_type", "deposit_type", "customer_type",
]
CORRELATION_COLUMNS = [
    "lead_time", "stays_in_weekend_nights", "stays_in_week_nights", "adults",
    "previous_cancellations", "previous_bookings_not_canceled", "booking_changes",
    "days_in_waiting_list", "adr", "required_car_parking_spaces",
    "total_of_special_requests", "is_canceled",
]
MONEY_COLUMNS = {"adr"}


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _rows(row: DataFrame, key: str, entries: list, names: list[str]) -> DataFrame:
    """Unpivot one aggregate row into a long table with one ``inline`` of an
    array of structs: entries are (label, [Column per output name]).  Two
    plan nodes however many columns are profiled (a stack over hundreds of
    intermediate columns makes analysis itself slow)."""
    arr = F.array(*[F.struct(F.lit(label).alias(key), *[c.alias(n) for c, n in zip(cols, names)])
                    for label, cols in entries])
    return row.select(F.inline(arr))


def _as_long(df: DataFrame, cols: Sequence[str], value: str = "value") -> DataFrame:
    """(column, value-as-string) pairs for ``cols`` via one generator."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(value))
                      for c in cols])
    return df.select(F.inline(pairs))


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


# B06
def domain_check_numeric(df: DataFrame, domains: dict = NUMERIC_DOMAINS) -> DataFrame:
    """Rows below / above each column's allowed range (nulls not counted)."""
    cols = _present(df, list(domains))
    aggs = []
    for c in cols:
        lo, hi = domains[c]
        aggs += [F.count_if(F.col(c) < lo).alias(f"{c}__below"),
                 F.count_if(F.col(c) > hi).alias(f"{c}__above")]
    row = df.agg(*aggs)
    entries = [(c, [F.lit(float(domains[c][0])), F.lit(float(domains[c][1])), F.col(f"{c}__below"),
                    F.col(f"{c}__above"), F.col(f"{c}__below") + F.col(f"{c}__above")]) for c in cols]
    return _rows(row, "column", entries, ["lo", "hi", "n_below", "n_above", "n_out"])


# B07
def domain_check_category(df: DataFrame, domains: dict | None = None) -> DataFrame:
    """Values outside each column's option list, with counts (null counts as outside)."""
    domains = domains or {**CATEGORY_DOMAINS, "country": COUNTRIES}
    cols = _present(df, list(domains))
    long = _as_long(df, cols)
    ok = None
    for c in cols:
        cond = (F.col("column") == c) & F.col("value").isin(domains[c])
        ok = cond if ok is None else ok | cond
    return (long.filter(~F.coalesce(ok, F.lit(False)))
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


# B08
def adr_fences(df: DataFrame, by: Sequence[str] = ("hotel", "reserved_room_type"),
               k: float = 1.5) -> DataFrame:
    """Upper ADR fence per hotel x room type: Q3 + k*IQR, in cents.  Quartiles
    are exact and distributed (:mod:`.quantiles`)."""
    q = quantiles(df, {"adr": cents("adr")}, [0.25, 0.75], by)
    return q.select(*by, (F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("fence_cents"))


def flag_adr_outliers(df: DataFrame, lo: float = 0.0, hi: float = 510.0,
                      by: Sequence[str] = ("hotel", "reserved_room_type"), k: float = 1.5) -> DataFrame:
    """Add ``adr_outlier`` (1/0).  Our reading of the cross-check: a rate
    outside [lo, hi], a positive rate on a stay of zero nights, or a rate
    above the fence of its own hotel x room type.  Fence table: one row per
    group; the join is left to AQE (broadcast when small at run time)."""
    f = adr_fences(df, by, k)
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    d = df.join(f, list(by), "left")
    bad = ((F.col("adr") < lo) | (F.col("adr") > hi) | ((nights == 0) & (F.col("adr") > 0))
           | (cents("adr") > F.col("fence_cents")))
    return d.withColumn("adr_outlier", F.coalesce(bad, F.lit(False)).cast("int"))


def drop_adr_outliers(df: DataFrame, **kw) -> DataFrame:
    return flag_adr_outliers(df, **kw).filter(F.col("adr_outlier") == 0).drop("adr_outlier")


# B09
def drop_leaky(df: DataFrame, leaky: Sequence[str] = ("deposit_type",)) -> DataFrame:
    """Model frame without leaky columns; the original frame is untouched."""
    return df.drop(*leaky)


# B10
def cleaning_log(df: DataFrame, steps: list[tuple[str, object]] | None = None) -> DataFrame:
    """Rows in / out per cleaning step, steps applied cumulatively, in one pass.

    ``steps`` are (name, keep-predicate Column).  Default steps (our choice):
    a booking with guests, ADR in its domain, no positive rate on zero
    nights, ADR under its group fence.
    """
    d = df
    if steps is None:
        d = flag_adr_outliers(df)
        guests = F.col("adults") + F.coalesce(F.col("children"), F.lit(0)) + F.col("babies")
        nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
        steps = [
            ("has_guests", guests > 0),
            ("adr_in_domain", F.col("adr").between(0.0, 510.0)),
            ("rate_needs_nights", ~((nights == 0) & (F.col("adr") > 0))),
            ("adr_under_fence", F.coalesce(cents("adr") <= F.col("fence_cents"), F.lit(True))),
        ]
    aggs, cum = [], F.lit(True)
    for i, (_, pred) in enumerate(steps):
        aggs.append(F.count_if(cum).alias(f"in{i}"))
        cum = cum & F.coalesce(pred, F.lit(False))
        aggs.append(F.count_if(cum).alias(f"out{i}"))
    row = d.agg(*aggs)
    entries = [(name, [F.lit(i + 1), F.col(f"in{i}"), F.col(f"out{i}"), F.col(f"in{i}") - F.col(f"out{i}")])
               for i, (name, _) in enumerate(steps)]
    return _rows(row, "step", entries, ["step_no", "rows_in", "rows_out", "dropped"])


# D18
def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"{c}__null") for c in cols])
    entries = [(c, [F.col(f"{c}__null"), F.col(f"{c}__null") / F.col("__n") * 100]) for c in cols]
    return _rows(row, "column", entries, ["n_null", "null_pct"])


def _numeric(c: str):
    """Column for profiling: money in exact cents, others as double."""
    return cents(c).cast("double") if c in MONEY_COLUMNS else F.col(c).cast("double")


def _scale(c: str) -> float:
    return 100.0 if c in MONEY_COLUMNS else 1.0


def _profile_buckets(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(values in long form, their first-pass buckets with moments), by column.

    A bucket holds, beside its count and range, exact sums of whole values in
    limbs of 31 bits (their squares cannot overflow for |x| < 2^61) and the
    stable moments of the others."""
    values = long_values(df, {c: _numeric(c) for c in cols})
    x = F.col("value")
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(float(1 << 61)))
    size = F.when(whole, F.abs(x)).cast("long")
    sign = F.signum(x).cast("long")
    high, low = F.shiftright(size, 31), size.bitwiseAND((1 << 31) - 1)
    big = high > 0
    add = lambda v, name: F.sum(v.cast("decimal(28,0)")).alias(name)
    extra = [F.every(whole).alias("whole"), add(sign * low, "sl"), add(low * low, "ll"), add(F.when(big, sign * high), "sh"),
             add(F.when(big, high * low), "hl"), add(F.when(big, high * high), "hh"),
             F.avg(x).alias("mean"), F.var_pop(x).alias("var")]
    from .learn import write_and_read
    return values, write_and_read(bucket_counts(values, extra=extra), "profile")


def _moments(rows: list) -> dict:
    """n, mean, sample sd, least, greatest and zero share of a column from its
    buckets; whole columns in integers, others by adding up central moments."""
    n = sum(r["n"] for r in rows)
    if all(r["whole"] for r in rows):
        total = lambda c: sum(int(r[c] or 0) for r in rows)
        s = total("sl") + (total("sh") << 31)
        ss = total("ll") + (total("hl") << 32) + (total("hh") << 62)
        mean, spread = s / n, Fraction(n * ss - s * s, n)
    else:
        mean = math.fsum(r["n"] * r["mean"] for r in rows) / n
        spread = math.fsum(r["n"] * (r["var"] + (r["mean"] - mean) ** 2) for r in rows)
    return {"n": n, "mean": mean, "sd": math.sqrt(spread / (n - 1)) if n > 1 else None, "min": min(r["lo"] for r in rows),
            "max": max(r["hi"] for r in rows), "zero_share": sum(r["n"] for r in rows if r["bucket"] == 0) / n}


# D19
def numeric_profile(df: DataFrame, cols: Sequence[str] = NUMERIC_PROFILE_COLUMNS) -> DataFrame:
    """n, mean, sd, min, quartiles, max, zero share per numeric column.

    One pass counts all columns' values in log buckets with their moments; the
    quartiles take further passes over the buckets that hold them
    (:mod:`.quantiles`).  Moments of whole columns are exact at any size and
    number of rows: the buckets' integer sums, at most a few thousand a column,
    are combined on the driver.
    """
    cols = _present(df, cols)
    values, buckets = _profile_buckets(df, cols)
    q = quantiles_of(values, buckets.select("column", "bucket", "n", "lo", "hi"), [0.25, 0.5, 0.75])
    quartiles = {r["column"]: r["q"] for r in q.collect()}
    by: dict[str, list] = {c: [] for c in cols}
    for r in buckets.collect():
        by[r["column"]].append(r)
    out = []
    for c in cols:
        if not by[c]:  # a column without values keeps its row
            out.append((c, 0, *[None] * 8))
            continue
        m, k = _moments(by[c]), _scale(c)
        sd = None if m["sd"] is None else m["sd"] / k
        sd = sd if sd is None or sd < 1e-3 else round(sd, 9)
        out.append((c, m["n"], m["mean"] / k, sd, m["min"] / k, *[v / k for v in quartiles[c]], m["max"] / k, m["zero_share"]))
    return df.sparkSession.createDataFrame(out, "`column` string, n long, mean double, sd double, min double, q1 double, median double, "
                                                "q3 double, max double, zero_share double")


# D20
def outlier_profile(df: DataFrame, cols: Sequence[str] = NUMERIC_PROFILE_COLUMNS, k: float = 1.5) -> DataFrame:
    """IQR fences per column and rows outside them: quartiles by selection, then
    one aggregate that counts all columns against their fences."""
    cols = _present(df, cols)
    q = {r["column"]: r["q"] for r in quantiles(df, {c: _numeric(c) for c in cols}, [0.25, 0.75]).collect()}
    fence = {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in q.items()}
    counts = [F.count_if(test(_numeric(c), fence[c][i])).alias(f"{c}__{i}") for c in fence
              for i, test in enumerate((lambda x, f: x < f, lambda x, f: (x > f) & ~F.isnan(x)))]
    row = df.agg(*counts or [F.count(F.lit(1))]).first()
    out = [(c, *[v / _scale(c) for v in (*q[c], *fence[c])], row[f"{c}__0"], row[f"{c}__1"]) if c in q else (c, *[None] * 4, 0, 0) for c in cols]
    return df.sparkSession.createDataFrame(out, "`column` string, q1 double, q3 double, lo_fence double, hi_fence double, n_below long, n_above long")


# D21
def category_profile(df: DataFrame, cols: Sequence[str] = CATEGORY_PROFILE_COLUMNS) -> DataFrame:
    """Value counts and share (of non-null values) per category column."""
    cols = _present(df, cols)
    g = (_as_long(df, cols).filter(F.col("value").isNotNull())
         .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    # per-column totals: one row per profiled column (a proven bound), so a
    # high-cardinality column never lands in a single task
    tot = g.groupBy("column").agg(F.sum("n").alias("_tot"))
    return g.join(F.broadcast(tot), "column").select(
        "column", "value", "n", (F.col("n") / F.col("_tot")).alias("share"))


# D23
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _exact(df: DataFrame, c: str) -> Column | None:
    """An integer-valued version of the column as DECIMAL(19,0), or None."""
    if c in MONEY_COLUMNS:
        return cents(c).cast("decimal(19,0)")
    return F.col(c).cast("decimal(19,0)") if dict(df.dtypes)[c] in _INTEGRAL else None


def mask_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per pattern of missing values (bit i: column i is present) the rows, the
    sums of all columns and of all products of two present ones.  One aggregate,
    no row is repeated; a sum beyond DECIMAL(38,0) is null."""
    x = [_exact(df, c) for c in cols]
    mask = sum((F.when(v.isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(x)), F.lit(0))
    sums = [F.try_sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    sums += [F.try_sum((x[i] * x[j]).cast("decimal(38,0)")).alias(f"p{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *sums)


def _pearson(rows: list, i: int, j: int) -> float | None:
    """r of columns i and j over the patterns that hold both, in integers;
    NaN if one of their sums went beyond DECIMAL(38,0)."""
    held = [r for r in rows if r["mask"] >> i & 1 and r["mask"] >> j & 1]
    names = (f"s{i}", f"s{j}", f"p{i}_{i}", f"p{j}_{j}", f"p{i}_{j}")
    if any(r[c] is None for r in held for c in names):
        return math.nan
    n = sum(r["n"] for r in held)
    sx, sy, sxx, syy, sxy = (sum(int(r[c]) for r in held) for c in names)
    left, right = n * sxx - sx * sx, n * syy - sy * sy
    return (n * sxy - sx * sy) / (math.sqrt(left) * math.sqrt(right)) if left and right else None


def correlation(df: DataFrame, cols: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Pearson r for every pair of columns, over the rows where both have a
    value; null where one of them does not vary or no row has both.

    Integer and money columns go through cross-moments by pattern of missing
    values: at most 2^columns rows of exact DECIMAL sums (few in practice), which
    are added up and combined as integers, free of overflow and cancellation and
    independent of partitioning.  Pairs with another kind of column, or with
    sums beyond 38 digits, use ``corr``.
    """
    cols = _present(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    whole = [c for c in cols if _exact(df, c) is not None]
    rows = mask_sums(df, whole).collect() if len(whole) > 1 else []
    r = {(a, b): _pearson(rows, whole.index(a), whole.index(b)) if a in whole and b in whole else math.nan for a, b in pairs}
    rest = [p for p in pairs if r[p] is not None and math.isnan(r[p])]
    if rest:
        value = lambda c: (_exact(df, c) if c in whole else F.col(c)).cast("double")
        found = df.agg(*[F.corr(value(a), value(b)).alias(f"r{k}") for k, (a, b) in enumerate(rest)]).first()
        r.update({p: found[k] for k, p in enumerate(rest)})
    out = [(a, b, None if r[a, b] is None or math.isnan(r[a, b]) else round(r[a, b], 9) + 0.0) for a, b in pairs]
    return df.sparkSession.createDataFrame(out, "col_a string, col_b string, r double")


# D24
def leakage_scan(df: DataFrame, cols: Sequence[str] = CATEGORY_PROFILE_COLUMNS,
                 lo: float = 0.02, hi: float = 0.98, min_n: int = MIN_SUPPORT,
                 label: str = LABEL) -> DataFrame:
    """Category values whose label rate is near 0 or 1 with large support
    (cuts are our choice)."""
    cols = _present(df, cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                               F.col(label).alias("y")) for c in cols])
    g = (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
         .groupBy("column", "value").agg(F.avg("y").alias("rate"), F.count("y").alias("n")))
    return g.filter((F.col("n") >= min_n) & ((F.col("rate") <= lo) | (F.col("rate") >= hi)))
