"""Cancellation-rate reports (D01-D17, D22, D26) and their building blocks
(J01-J03, T01-T03, B01-B03).

Every report is a ``groupBy`` with map-side partial aggregation: the shuffle
carries one row per group per task, never the bookings.  Ranks and shares
are windows over the *aggregated* table, whose size is bounded by the number
of groups (hotels, months, segments, countries), not by the data.  Overall
rates are scalar subqueries (``DataFrame.scalar()``), not joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BAND_AMBER_LEAD, BAND_AMBER_MONTH, LEAD_LABELS, MIN_SUPPORT, TOP_K
from ..functions import features as fx
from ..functions.numeric import cents, safe_div
from .quantiles import quantiles

LABEL = "is_canceled"


def _rate_aggs(label: str = LABEL) -> list[Column]:
    # mean and count skip null labels (pandas semantics); rate in percent, unrounded
    return [(F.avg(label) * 100).alias("cr"), F.count(label).alias("n")]


def rate_table(df: DataFrame, keys: Sequence, label: str = LABEL) -> DataFrame:
    """Cancel rate (percent) and labelled-row count per key; null keys dropped."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    cond = None
    for k in keys:
        cond = k.isNotNull() if cond is None else cond & k.isNotNull()
    return df.filter(cond).groupBy(*keys).agg(*_rate_aggs(label))


def overall_rate(df: DataFrame, label: str = LABEL) -> Column:
    """Overall cancel % as a scalar subquery column."""
    return df.agg((F.avg(label) * 100).alias("overall_cr")).scalar()


def rank_by(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row number over an aggregated table.  The window has no partition, so
    it runs in one task: only ever applied to tables bounded by the number of
    groups (hotels, months, segments, countries), never to bookings."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


# B01
def filter_hotel(df: DataFrame, hotel: str | None) -> DataFrame:
    return df if hotel is None else df.filter(F.col("hotel") == hotel)


# D01 / B02
def headline(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), (F.avg(label) * 100).alias("cancel_rate"))


def filtered_headline(df: DataFrame, hotel: str | None) -> DataFrame:
    return headline(filter_hotel(df, hotel))


# B03
def min_support(rates: DataFrame, k: int = MIN_SUPPORT) -> DataFrame:
    return rates.filter(F.col("n") >= k)


# T02 helper
def with_month_num(df: DataFrame, col: str = "arrival_date_month") -> DataFrame:
    return df.withColumn("month_num", fx.month_number(col, default=None))


# D02
def calendar_sort(df: DataFrame, *then: str) -> DataFrame:
    """Rows in calendar order of ``month_num`` (unknown months last)."""
    return df.orderBy(F.col("month_num").asc_nulls_last(), *then)


def month_hotel_rate(df: DataFrame) -> DataFrame:
    return calendar_sort(with_month_num(rate_table(df, ["arrival_date_month", "hotel"])), "hotel")


# D03
def hotel_stats(df: DataFrame, label: str = LABEL) -> DataFrame:
    g = (df.filter(F.col("hotel").isNotNull()).groupBy("hotel")
         .agg((F.avg(label) * 100).alias("cr"), F.count(label).alias("total"),
              F.sum(label).cast("long").alias("canceled")))
    return g.withColumn("not_canceled", F.col("total") - F.col("canceled"))


# D04 / D05
def country_hotel_rate(df: DataFrame) -> DataFrame:
    return rate_table(df, ["country", "hotel"])


def segment_hotel_rate(df: DataFrame) -> DataFrame:
    return rate_table(df, ["market_segment", "hotel"])


# C16 applied
def with_lead_bin(df: DataFrame, labels: Sequence[str] = LEAD_LABELS) -> DataFrame:
    return df.withColumns({"lead_bin": fx.lead_bin("lead_time", labels),
                           "lead_bin_no": fx.lead_bin_no("lead_time")})


# J03 + D06
def complete_grid(rates: DataFrame, df: DataFrame, labels: Sequence[str] = LEAD_LABELS) -> DataFrame:
    """Every lead bin x observed hotel, empty pairs kept with n=0, cr=null.

    The grid is the distinct hotels with the fixed bin list exploded onto
    them (a generator, not a join of two tables); it is then left-joined to
    the aggregate.  Both sides have (#bins x #hotels) rows at most.
    """
    bins = F.array(*[F.struct(F.lit(lab).alias("lead_bin"), F.lit(i).alias("lead_bin_no"))
                     for i, lab in enumerate(labels, start=1)])
    grid = (df.filter(F.col("hotel").isNotNull()).select("hotel").distinct()
            .select(F.explode(bins).alias("b"), "hotel")
            .select("b.lead_bin", "b.lead_bin_no", "hotel"))
    out = grid.join(rates, ["lead_bin", "lead_bin_no", "hotel"], "left")
    return out.withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long")))


def lead_hotel_rate(df: DataFrame, complete: bool = True) -> DataFrame:
    rates = rate_table(with_lead_bin(df), ["lead_bin", "lead_bin_no", "hotel"])
    return complete_grid(rates, df) if complete else rates


# D07 + C20 + T02
def month_rate(df: DataFrame, hotel: str | None = None) -> DataFrame:
    r = with_month_num(rate_table(filter_hotel(df, hotel), ["arrival_date_month"]))
    return calendar_sort(r.withColumn("band", fx.rate_band("cr", BAND_AMBER_MONTH)))


# D08 = B03 + T01
def topk_by_rate(rates: DataFrame, key, k: int = TOP_K) -> DataFrame:
    """k largest rates; ties keep the smaller key first (group-key order).
    Planned as TakeOrderedAndProject: each task keeps its own top k."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col("cr").desc()] + [F.col(c).asc() for c in keys]
    return rank_by(rates.orderBy(*order).limit(k), order)


def country_top10(df: DataFrame, hotel: str | None = None, min_n: int = MIN_SUPPORT,
                  k: int = TOP_K) -> DataFrame:
    rates = min_support(rate_table(filter_hotel(df, hotel), ["country"]), min_n)
    return topk_by_rate(rates, "country", k)


# D09 + T03
def rate_sort(rates: DataFrame, key: str, descending: bool = True) -> DataFrame:
    o = F.col("cr").desc() if descending else F.col("cr").asc()
    return rank_by(rates, [o, F.col(key).asc()])


def segment_rate(df: DataFrame, hotel: str | None = None) -> DataFrame:
    return rate_sort(rate_table(filter_hotel(df, hotel), ["market_segment"]), "market_segment")


# D10 + C20
def lead_rate(df: DataFrame, hotel: str | None = None) -> DataFrame:
    r = rate_table(with_lead_bin(filter_hotel(df, hotel)), ["lead_bin", "lead_bin_no"])
    return r.withColumn("band", fx.rate_band("cr", BAND_AMBER_LEAD))


# D11
def lead_transient_rate(df: DataFrame, hotel: str | None = None) -> DataFrame:
    d = with_lead_bin(filter_hotel(df, hotel)).withColumn(
        "is_transient", F.coalesce((F.col("customer_type") == "Transient").cast("int"), F.lit(0)))
    r = rate_table(d, ["lead_bin", "lead_bin_no", "is_transient"])
    return r.withColumn("guest_type", F.when(F.col("is_transient") == 1, "Transient")
                        .otherwise("Non-Transient"))


# J02 + D12
def rate_vs_overall(rates: DataFrame, df: DataFrame, label: str = LABEL) -> DataFrame:
    return (rates.withColumn("overall_cr", overall_rate(df, label))
            .withColumn("delta_pp", F.col("cr") - F.col("overall_cr")))


def hotel_delta(df: DataFrame) -> DataFrame:
    return rate_vs_overall(rate_table(df, ["hotel"]), df)


# D13 / D14 on a scored frame
def batch_summary(scored: DataFrame, pred: str = "prediction") -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("rows"),
                      F.sum(pred).cast("long").alias("predicted_cancel"),
                      (F.avg(pred) * 100).alias("predicted_cancel_pct"))


def risk_mix(scored: DataFrame, label: str = "risk_label") -> DataFrame:
    return scored.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


# D15
def kpi_summary(df: DataFrame) -> DataFrame:
    """Per hotel: cancel %, mean lead time, mean ADR (mean over cents / 100)."""
    return (df.filter(F.col("hotel").isNotNull()).groupBy("hotel")
            .agg((F.avg(LABEL) * 100).alias("cr"), F.avg("lead_time").alias("mean_lead_time"),
                 (F.avg(cents("adr")) / 100).alias("mean_adr"), F.count(F.lit(1)).alias("n")))


# D16
def revpar(df: DataFrame, capacity: DataFrame) -> DataFrame:
    """Revenue per available room: room revenue of kept (not canceled)
    bookings / (rooms x days).  ``capacity`` (hotel, rooms, days) comes from
    the user, one row per property; both sides of the join are aggregates."""
    rev = (df.filter((F.col(LABEL) == 0) & F.col("hotel").isNotNull()).groupBy("hotel")
           .agg(F.sum(cents("adr") * (F.col("stays_in_weekend_nights")
                                     + F.col("stays_in_week_nights"))).alias("revenue_cents"),
                F.count(F.lit(1)).alias("kept")))
    cap = capacity.select("hotel", F.col("rooms").cast("long"), F.col("days").cast("long"))
    out = rev.join(cap, "hotel", "inner")
    return out.select("hotel", "kept", "rooms", "days",
                      (F.col("revenue_cents") / 100).alias("revenue"),
                      safe_div(F.col("revenue_cents") / 100,
                               F.col("rooms") * F.col("days")).alias("revpar"))


# D17
def target_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("share", F.col("n") / total)


# D22
def bivariate_rate(df: DataFrame, col: str, q: int = 4, label: str = LABEL) -> DataFrame:
    """Cancel rate by ``q`` quantile bins of a numeric column.

    Cut points are exact, distributed quantiles (:mod:`.quantiles`).  Bins are
    right-closed: bin i holds cut(i-1) < x <= cut(i).  Our choice where the
    reference gives no rule.
    """
    cuts = quantiles(df, {col: F.col(col)}, [i / q for i in range(1, q)]).select("q").scalar()
    x = F.col(col)
    bin_no = F.lit(1)
    for i in range(q - 1):
        bin_no = bin_no + (x > cuts[i]).cast("int")
    d = df.filter(x.isNotNull()).withColumn("bin", bin_no)
    return d.groupBy("bin").agg(F.min(col).cast("double").alias("lo"),
                                F.max(col).cast("double").alias("hi"), *_rate_aggs(label))


# D26
def season_rate(df: DataFrame) -> DataFrame:
    """Rate by hotel x season with rollup subtotals (level: 0 detail,
    1 hotel subtotal, 3 grand total)."""
    d = df.withColumn("arrival_season", fx.arrival_season(fx.month_number("arrival_date_month")))
    return (d.rollup("hotel", "arrival_season")
            .agg(*_rate_aggs(), F.grouping_id().cast("int").alias("level")))
