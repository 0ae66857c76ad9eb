"""Scalar booking features as native column expressions.

No Python UDF anywhere: each function returns a ``Column`` that Catalyst folds
into whole-stage codegen, so the 29-column feature step is one narrow
projection with no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ADVICE_ACTIONS, ADVICE_MEDIUM, ADVICE_VERY_HIGH, BAND_RED,
                         COUNTRIES, FEATURE_COLUMNS, GAUGE_AMBER, GAUGE_RED, HARD_REQUIRED,
                         LEAD_EDGES, LEAD_LABELS, MONTHS, RISK_EDGES, RISK_LABELS,
                         SEASON_OF_MONTH, THRESHOLD)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _count(x) -> Column:
    """Null -> 0, then truncate toward zero like Python ``int()``."""
    return F.coalesce(_c(x), F.lit(0)).cast("int")


# C01
def month_number(month="arrival_date_month", default: int | None = 1) -> Column:
    """Month name -> 1..12; unknown or null -> ``default`` (None keeps null)."""
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), _c(month))
    num = F.when(pos > 0, pos.cast("int"))
    return num if default is None else F.coalesce(num, F.lit(default))


# C02
def month_sin(m) -> Column:
    return F.sin(F.lit(2 * math.pi) * _c(m) / 12)


def month_cos(m) -> Column:
    return F.cos(F.lit(2 * math.pi) * _c(m) / 12)


# C03
def arrival_season(m) -> Column:
    pairs = [x for k, v in sorted(SEASON_OF_MONTH.items()) for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), _c(m))


# C04
def country_grouped(country="country") -> Column:
    """Listed country kept; null or unlisted -> 'Other'."""
    c = _c(country)
    return F.when(c.isin(COUNTRIES), c).otherwise(F.lit("Other"))


# C05
def lead_x_transient(lead="lead_time", ctype="customer_type") -> Column:
    is_t = F.coalesce((_c(ctype) == "Transient").cast("int"), F.lit(0))
    return F.coalesce(_c(lead), F.lit(0)) * is_t


# C06
def is_weekend_only(week="stays_in_week_nights", weekend="stays_in_weekend_nights") -> Column:
    return ((F.coalesce(_c(week), F.lit(0)) == 0)
            & (F.coalesce(_c(weekend), F.lit(0)) > 0)).cast("int")


# C07-C09
def babies_bin(x="babies") -> Column:
    return F.when(_count(x) > 0, "has_baby").otherwise("no_baby")


def children_bin(x="children") -> Column:
    return F.when(_count(x) > 0, "has_children").otherwise("no_children")


def parking_bin(x="required_car_parking_spaces") -> Column:
    return F.when(_count(x) > 0, "has_parking").otherwise("no_parking")


# C10-C12 (the order of tests matters: negative counts fall through)
def prev_cancel_bin(x="previous_cancellations") -> Column:
    n = _count(x)
    return F.when(n == 0, "never").when(n == 1, "once").otherwise("multiple")


def prev_loyal_bin(x="previous_bookings_not_canceled") -> Column:
    n = _count(x)
    return F.when(n == 0, "none").when(n <= 3, "some").otherwise("many")


def booking_changes_bin(x="booking_changes") -> Column:
    n = _count(x)
    return F.when(n == 0, "none").when(n <= 2, "some").otherwise("many")


# C13 (compares the raw values, not the truncated ones)
def no_commitment(parking="required_car_parking_spaces", requests="total_of_special_requests") -> Column:
    return ((F.coalesce(_c(parking), F.lit(0)) == 0)
            & (F.coalesce(_c(requests), F.lit(0)) == 0)).cast("int")


# C14
def sentinel_id(x, dtype: str | None = None) -> Column:
    """agent/company id: non-numeric -> null, 0 -> null."""
    c = _c(x)
    v = c.try_cast("double") if dtype == "string" else c.cast("double")
    return F.nullif(v, F.lit(0.0))


# Right-closed cuts like pandas ``cut``; outside the edges -> null
def right_closed_cut(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    c = _c(x)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


def right_closed_bin_no(x, edges: Sequence[float]) -> Column:
    c = _c(x)
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]), start=1):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def lead_bin(x="lead_time", labels: Sequence[str] = LEAD_LABELS) -> Column:
    return right_closed_cut(x, LEAD_EDGES, labels)


def lead_bin_no(x="lead_time") -> Column:
    return right_closed_bin_no(x, LEAD_EDGES)


def risk_label(p, labels: Sequence[str] = RISK_LABELS) -> Column:
    return right_closed_cut(p, RISK_EDGES, labels)


# B04
def decision(p, threshold: float = THRESHOLD) -> Column:
    """1 when the *unrounded* probability reaches the threshold (tie = cancel)."""
    return (_c(p) >= threshold).cast("int")


# C18
def risk_grade(p, pred) -> Column:
    p, pred = _c(p), _c(pred)
    return (F.when((pred == 1) & (p >= ADVICE_VERY_HIGH), "very_high")
            .when(pred == 1, "high")
            .when(p >= ADVICE_MEDIUM, "medium")
            .otherwise("low"))


def risk_actions(grade) -> Column:
    pairs = []
    for k, acts in ADVICE_ACTIONS.items():
        pairs += [F.lit(k), F.array(*[F.lit(a) for a in acts])]
    return F.element_at(F.create_map(*pairs), _c(grade))


# C19
def gauge_band(p) -> Column:
    p = _c(p)
    return F.when(p >= GAUGE_RED, "red").when(p >= GAUGE_AMBER, "amber").otherwise("green")


# C20
def rate_band(cr, amber: float, red: float = BAND_RED) -> Column:
    cr = _c(cr)
    return F.when(cr >= red, "red").when(cr >= amber, "amber").otherwise("green")


# C21
def prob_round(p, digits: int = 4) -> Column:
    """Round half to even on the binary value (NumPy ``round``); Spark's
    ``round`` is half-up and ``bround`` works on the decimal text."""
    s = float(10 ** digits)
    return F.rint(_c(p) * s) / s


# C15
# columns filled with 0 when absent from a batch (everything the feature
# step only selects); a missing ``company`` becomes null instead.
FILL_WITH_ZERO = ["hotel", "adults", "meal", "market_segment", "distribution_channel",
                  "is_repeated_guest", "reserved_room_type", "agent",
                  "days_in_waiting_list", "adr", "country_grouped"]


def feature_matrix(df: DataFrame, keep: Sequence[str] = ("booking_id",),
                   fill_missing: bool = False, validate_grouped: bool = False) -> DataFrame:
    """The 29 model features in model order, as one projection.

    ``keep`` columns (e.g. the key) are carried in front.  Missing
    hard-required columns raise; other missing columns raise unless
    ``fill_missing`` (then 0, or null for ``company``), matching the batch
    path of the reference.  An existing ``country_grouped`` is trusted as is
    unless ``validate_grouped``.
    """
    cols = set(df.columns)
    missing_hard = [c for c in HARD_REQUIRED if c not in cols]
    if missing_hard:
        raise ValueError(f"missing required columns: {missing_hard}")
    m = month_number("arrival_date_month")
    if "country_grouped" in cols:
        cg = country_grouped("country_grouped") if validate_grouped else F.col("country_grouped")
    elif "country" in cols:
        cg = country_grouped("country")
    else:
        cg = None
    derived = {
        "arrival_season": arrival_season(m),
        "month_sin": month_sin(m),
        "month_cos": month_cos(m),
        "lead_x_transient": lead_x_transient(),
        "is_weekend_only": is_weekend_only(),
        "babies_bin": babies_bin(),
        "children_bin": children_bin(),
        "parking_bin": parking_bin(),
        "prev_cancel_bin": prev_cancel_bin(),
        "prev_loyal_bin": prev_loyal_bin(),
        "booking_changes_bin": booking_changes_bin(),
        "no_commitment": no_commitment(),
    }
    if cg is not None:
        derived["country_grouped"] = cg
    str_types = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    if "company" in cols:
        derived["company"] = sentinel_id("company", "string" if "company" in str_types else None)
    else:
        derived["company"] = F.lit(None).cast("double")
    if "agent" in cols:
        derived["agent"] = sentinel_id("agent", "string" if "agent" in str_types else None)
    out = []
    for name in FEATURE_COLUMNS:
        if name in derived:
            out.append(derived[name].alias(name))
        elif name in cols:
            out.append(F.col(name))
        elif fill_missing and name in FILL_WITH_ZERO:
            out.append(F.lit(0).alias(name))
        else:
            raise ValueError(f"missing column {name!r} (pass fill_missing=True to fill with 0)")
    return df.select(*[F.col(k) for k in keep if k in cols], *out)
