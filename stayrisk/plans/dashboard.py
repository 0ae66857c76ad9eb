"""Registered queries: scalar features, dashboard reports, data quality.

Each query reads the driver tables through :func:`bookings` and is paired
with its DuckDB twin over the same bookings definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (ADVICE_ACTIONS, CATEGORY_DOMAINS, COUNTRIES, FEATURE_COLUMNS,
                         NUMERIC_DOMAINS)
from ..functions import features as fx
from ..functions.numeric import stable
from ..operators import quality as qy
from ..operators import stats as st
from ..sources.bookings import bookings, duckdb_with_bookings as W
from . import sql_snippets as S
from .registry import query

BK = "bookings"


def scored(spark, sf):
    """Bookings + the three result columns, with the fixture ``score`` in the
    model's place (F14 without a model)."""
    b = bookings(spark, sf)
    return b.withColumns({"cancel_probability": fx.prob_round("score"),
                          "prediction": fx.decision("score"),
                          "risk_label": fx.risk_label("score")})


# ---------------------------------------------------------------- features
@query("month_number", W(f"SELECT booking_id, arrival_date_month, {S.MONTH_NUM} AS month_num FROM bookings"))
def q_month_number(spark, sf):
    return bookings(spark, sf).select("booking_id", "arrival_date_month",
                                      fx.month_number().alias("month_num"))


@query("month_cyclic", W(f"SELECT booking_id, m AS month_num, {S.stable('sin(2*pi()*m/12)')} AS month_sin, "
                         f"{S.stable('cos(2*pi()*m/12)')} AS month_cos FROM (SELECT *, {S.MONTH_NUM} AS m FROM bookings)"))
def q_month_cyclic(spark, sf):
    m = fx.month_number()
    return bookings(spark, sf).select("booking_id", m.alias("month_num"),
                                      stable(fx.month_sin(m)).alias("month_sin"),
                                      stable(fx.month_cos(m)).alias("month_cos"))


@query("arrival_season", W(f"SELECT booking_id, arrival_date_month, {S.season(S.MONTH_NUM)} AS arrival_season FROM bookings"))
def q_arrival_season(spark, sf):
    return bookings(spark, sf).select("booking_id", "arrival_date_month",
                                      fx.arrival_season(fx.month_number()).alias("arrival_season"))


@query("country_grouped", W(f"SELECT booking_id, country, {S.COUNTRY_GROUPED} AS country_grouped FROM bookings"))
def q_country_grouped(spark, sf):
    return bookings(spark, sf).select("booking_id", "country", fx.country_grouped().alias("country_grouped"))


@query("lead_x_transient", W(f"SELECT booking_id, lead_time, customer_type, {S.LEAD_X_TRANSIENT} AS lead_x_transient FROM bookings"))
def q_lead_x_transient(spark, sf):
    return bookings(spark, sf).select("booking_id", "lead_time", "customer_type",
                                      fx.lead_x_transient().alias("lead_x_transient"))


@query("is_weekend_only", W(f"SELECT booking_id, {S.IS_WEEKEND_ONLY} AS is_weekend_only FROM bookings"))
def q_is_weekend_only(spark, sf):
    return bookings(spark, sf).select("booking_id", fx.is_weekend_only().alias("is_weekend_only"))


def _bin_query(name, fn, sql_expr, src, as_double=()):
    @query(name, W(f"SELECT booking_id, {src}, {sql_expr} AS {name} FROM bookings"), as_double=as_double)
    def q(spark, sf):
        return bookings(spark, sf).select("booking_id", src, fn().alias(name))
    q.__name__ = f"q_{name}"
    return q


_bin_query("babies_bin", fx.babies_bin, S.BABIES_BIN, "babies")
_bin_query("children_bin", fx.children_bin, S.CHILDREN_BIN, "children", as_double=("children",))
_bin_query("parking_bin", fx.parking_bin, S.PARKING_BIN, "required_car_parking_spaces")
_bin_query("prev_cancel_bin", fx.prev_cancel_bin, S.PREV_CANCEL_BIN, "previous_cancellations")
_bin_query("prev_loyal_bin", fx.prev_loyal_bin, S.PREV_LOYAL_BIN, "previous_bookings_not_canceled")
_bin_query("booking_changes_bin", fx.booking_changes_bin, S.CHANGES_BIN, "booking_changes")


@query("no_commitment", W(f"SELECT booking_id, {S.NO_COMMITMENT} AS no_commitment FROM bookings"))
def q_no_commitment(spark, sf):
    return bookings(spark, sf).select("booking_id", fx.no_commitment().alias("no_commitment"))


@query("sentinel_ids", W("SELECT booking_id, nullif(agent, 0.0) AS agent_id, nullif(company, 0.0) AS company_id FROM bookings"))
def q_sentinel_ids(spark, sf):
    return bookings(spark, sf).select("booking_id", fx.sentinel_id("agent").alias("agent_id"),
                                      fx.sentinel_id("company").alias("company_id"))


_FM_SQL = {
    "agent": "nullif(agent, 0.0)", "company": "nullif(company, 0.0)",
    "country_grouped": S.COUNTRY_GROUPED, "arrival_season": S.season("m"),
    "month_sin": S.stable("sin(2*pi()*m/12)"), "month_cos": S.stable("cos(2*pi()*m/12)"),
    "babies_bin": S.BABIES_BIN, "children_bin": S.CHILDREN_BIN, "parking_bin": S.PARKING_BIN,
    "prev_cancel_bin": S.PREV_CANCEL_BIN, "prev_loyal_bin": S.PREV_LOYAL_BIN,
    "booking_changes_bin": S.CHANGES_BIN, "no_commitment": S.NO_COMMITMENT,
    "lead_x_transient": S.LEAD_X_TRANSIENT, "is_weekend_only": S.IS_WEEKEND_ONLY,
}
_FM_SELECT = ", ".join(f"{_FM_SQL.get(c, c)} AS {c}" for c in FEATURE_COLUMNS)


@query("feature_matrix", W(f"SELECT booking_id, {_FM_SELECT} FROM (SELECT *, {S.MONTH_NUM} AS m FROM bookings)"))
def q_feature_matrix(spark, sf):
    fm = fx.feature_matrix(bookings(spark, sf))
    return fm.withColumns({"month_sin": stable("month_sin"), "month_cos": stable("month_cos")})


@query("lead_bin", W(f"SELECT booking_id, lead_time, {S.LEAD_BIN} AS lead_bin, {S.LEAD_BIN_NO} AS lead_bin_no FROM bookings"), as_double=("lead_bin_no",))
def q_lead_bin(spark, sf):
    return st.with_lead_bin(bookings(spark, sf)).select("booking_id", "lead_time", "lead_bin", "lead_bin_no")


@query("risk_label", W(f"SELECT booking_id, score, {S.risk_label('score')} AS risk_label FROM bookings"))
def q_risk_label(spark, sf):
    return bookings(spark, sf).select("booking_id", "score", fx.risk_label("score").alias("risk_label"))


_GRADE = ("CASE WHEN prediction = 1 AND score >= 0.75 THEN 'very_high' WHEN prediction = 1 THEN 'high' "
          "WHEN score >= 0.40 THEN 'medium' ELSE 'low' END")
_ACTIONS_SQL = ("CASE grade " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, " | ".join(v).replace("'", "''"))
    for k, v in ADVICE_ACTIONS.items()) + " END")


@query("risk_action", W(f"SELECT booking_id, score, prediction, grade, {_ACTIONS_SQL} AS actions FROM "
                        f"(SELECT *, {_GRADE} AS grade FROM (SELECT booking_id, score, {S.decision('score')} AS prediction FROM bookings))"))
def q_risk_action(spark, sf):
    b = bookings(spark, sf).select("booking_id", "score", fx.decision("score").alias("prediction"))
    b = b.withColumn("grade", fx.risk_grade("score", "prediction"))
    return b.withColumn("actions", F.array_join(fx.risk_actions("grade"), " | "))


@query("gauge_band", W("SELECT booking_id, score, CASE WHEN score >= 0.65 THEN 'red' WHEN score >= 0.40 "
                       "THEN 'amber' ELSE 'green' END AS gauge FROM bookings"))
def q_gauge_band(spark, sf):
    return bookings(spark, sf).select("booking_id", "score", fx.gauge_band("score").alias("gauge"))


@query("prob_round", W(f"SELECT booking_id, score, {S.prob_round('score')} AS cancel_probability FROM bookings"))
def q_prob_round(spark, sf):
    return bookings(spark, sf).select("booking_id", "score", fx.prob_round("score").alias("cancel_probability"))


@query("decision", W(f"SELECT booking_id, score, {S.decision('score')} AS prediction FROM bookings"))
def q_decision(spark, sf):
    return bookings(spark, sf).select("booking_id", "score", fx.decision("score").alias("prediction"))


# ---------------------------------------------------------------- dashboard
_RATE = "avg(is_canceled) * 100 AS cr, count(is_canceled) AS n"
_MONTH_NUM_NULL = S.MONTH_CASE


def _band(amber):
    return f"CASE WHEN cr >= 35.0 THEN 'red' WHEN cr >= {amber} THEN 'amber' ELSE 'green' END"


@query("filter_hotel", W("SELECT * FROM bookings WHERE hotel = 'City Hotel'"), as_double=("children",))
def q_filter_hotel(spark, sf):
    return st.filter_hotel(bookings(spark, sf), "City Hotel")


@query("filtered_headline", W("SELECT count(*) AS total, avg(is_canceled) * 100 AS cancel_rate FROM bookings WHERE hotel = 'Resort Hotel'"))
def q_filtered_headline(spark, sf):
    return st.filtered_headline(bookings(spark, sf), "Resort Hotel")


@query("headline", W("SELECT count(*) AS total, avg(is_canceled) * 100 AS cancel_rate FROM bookings"))
def q_headline(spark, sf):
    return st.headline(bookings(spark, sf))


@query("min_support", W(f"SELECT country, market_segment, {_RATE} FROM bookings WHERE country IS NOT NULL "
                        "AND market_segment IS NOT NULL GROUP BY country, market_segment HAVING count(is_canceled) >= 200"))
def q_min_support(spark, sf):
    return st.min_support(st.rate_table(bookings(spark, sf), ["country", "market_segment"]))


@query("month_hotel_rate", W(f"SELECT arrival_date_month, hotel, {_RATE}, {_MONTH_NUM_NULL} AS month_num FROM bookings "
                             "WHERE arrival_date_month IS NOT NULL AND hotel IS NOT NULL GROUP BY arrival_date_month, hotel"))
def q_month_hotel_rate(spark, sf):
    return st.month_hotel_rate(bookings(spark, sf))


@query("hotel_stats", W("SELECT hotel, avg(is_canceled) * 100 AS cr, count(is_canceled) AS total, "
                        "CAST(sum(is_canceled) AS BIGINT) AS canceled, count(is_canceled) - CAST(sum(is_canceled) AS BIGINT) AS not_canceled "
                        "FROM bookings WHERE hotel IS NOT NULL GROUP BY hotel"))
def q_hotel_stats(spark, sf):
    return st.hotel_stats(bookings(spark, sf))


@query("country_hotel_rate", W(f"SELECT country, hotel, {_RATE} FROM bookings WHERE country IS NOT NULL AND hotel IS NOT NULL GROUP BY country, hotel"))
def q_country_hotel_rate(spark, sf):
    return st.country_hotel_rate(bookings(spark, sf))


@query("segment_hotel_rate", W(f"SELECT market_segment, hotel, {_RATE} FROM bookings WHERE market_segment IS NOT NULL AND hotel IS NOT NULL GROUP BY market_segment, hotel"))
def q_segment_hotel_rate(spark, sf):
    return st.segment_hotel_rate(bookings(spark, sf))


_BINS_VALUES = "(VALUES ('0–7', 1), ('8–30', 2), ('31–90', 3), ('91–180', 4), ('181+', 5)) AS v(lead_bin, lead_bin_no)"


@query("lead_hotel_rate", W(
    "SELECT g.lead_bin, g.lead_bin_no, g.hotel, r.cr, coalesce(r.n, 0) AS n FROM "
    f"(SELECT v.lead_bin, v.lead_bin_no, h.hotel FROM (SELECT DISTINCT hotel FROM bookings WHERE hotel IS NOT NULL) h, {_BINS_VALUES}) g "
    f"LEFT JOIN (SELECT lead_bin, lead_bin_no, hotel, {_RATE} FROM (SELECT *, {S.LEAD_BIN} AS lead_bin, {S.LEAD_BIN_NO} AS lead_bin_no FROM bookings) "
    "WHERE lead_bin IS NOT NULL AND lead_bin_no IS NOT NULL AND hotel IS NOT NULL GROUP BY lead_bin, lead_bin_no, hotel) r "
    "ON g.lead_bin = r.lead_bin AND g.lead_bin_no = r.lead_bin_no AND g.hotel = r.hotel"))
def q_lead_hotel_rate(spark, sf):
    return st.lead_hotel_rate(bookings(spark, sf), complete=True)


@query("month_rate", W(f"SELECT *, {_band(28.0)} AS band FROM (SELECT arrival_date_month, {_RATE}, {_MONTH_NUM_NULL} AS month_num "
                       "FROM bookings WHERE hotel = 'City Hotel' AND arrival_date_month IS NOT NULL GROUP BY arrival_date_month)"))
def q_month_rate(spark, sf):
    return st.month_rate(bookings(spark, sf), "City Hotel")


@query("month_band", W(f"SELECT *, {_band(28.0)} AS band FROM (SELECT arrival_date_month, {_RATE}, {_MONTH_NUM_NULL} AS month_num "
                       "FROM bookings WHERE arrival_date_month IS NOT NULL GROUP BY arrival_date_month)"))
def q_month_band(spark, sf):
    return st.month_rate(bookings(spark, sf), None)


@query("country_top10", W(f"SELECT *, row_number() OVER (ORDER BY cr DESC, country ASC) AS rank FROM "
                          f"(SELECT country, {_RATE} FROM bookings WHERE country IS NOT NULL GROUP BY country "
                          "HAVING count(is_canceled) >= 200 ORDER BY cr DESC, country ASC LIMIT 10)"))
def q_country_top10(spark, sf):
    return st.country_top10(bookings(spark, sf))


@query("topk_by_rate", W(f"SELECT *, row_number() OVER (ORDER BY cr DESC, market_segment ASC, hotel ASC) AS rank FROM "
                         f"(SELECT market_segment, hotel, {_RATE} FROM bookings WHERE market_segment IS NOT NULL AND hotel IS NOT NULL "
                         "GROUP BY market_segment, hotel ORDER BY cr DESC, market_segment ASC, hotel ASC LIMIT 5)"))
def q_topk_by_rate(spark, sf):
    return st.topk_by_rate(st.segment_hotel_rate(bookings(spark, sf)), ["market_segment", "hotel"], 5)


@query("segment_rate", W(f"SELECT *, row_number() OVER (ORDER BY cr DESC, market_segment ASC) AS rank FROM "
                         f"(SELECT market_segment, {_RATE} FROM bookings WHERE market_segment IS NOT NULL GROUP BY market_segment)"))
def q_segment_rate(spark, sf):
    return st.segment_rate(bookings(spark, sf))


@query("rate_sort", W(f"SELECT *, row_number() OVER (ORDER BY cr ASC, country ASC) AS rank FROM "
                      f"(SELECT country, {_RATE} FROM bookings WHERE country IS NOT NULL GROUP BY country)"))
def q_rate_sort(spark, sf):
    return st.rate_sort(st.rate_table(bookings(spark, sf), ["country"]), "country", descending=False)


@query("lead_rate", W(f"SELECT *, {_band(25.0)} AS band FROM (SELECT lead_bin, lead_bin_no, {_RATE} FROM "
                      f"(SELECT *, {S.LEAD_BIN} AS lead_bin, {S.LEAD_BIN_NO} AS lead_bin_no FROM bookings WHERE hotel = 'Resort Hotel') "
                      "WHERE lead_bin IS NOT NULL GROUP BY lead_bin, lead_bin_no)"))
def q_lead_rate(spark, sf):
    return st.lead_rate(bookings(spark, sf), "Resort Hotel")


@query("lead_band", W(f"SELECT *, {_band(25.0)} AS band FROM (SELECT lead_bin, lead_bin_no, {_RATE} FROM "
                      f"(SELECT *, {S.LEAD_BIN} AS lead_bin, {S.LEAD_BIN_NO} AS lead_bin_no FROM bookings) "
                      "WHERE lead_bin IS NOT NULL GROUP BY lead_bin, lead_bin_no)"))
def q_lead_band(spark, sf):
    return st.lead_rate(bookings(spark, sf), None)


@query("lead_transient_rate", W(
    f"SELECT *, CASE WHEN is_transient = 1 THEN 'Transient' ELSE 'Non-Transient' END AS guest_type FROM "
    f"(SELECT lead_bin, lead_bin_no, is_transient, {_RATE} FROM (SELECT *, {S.LEAD_BIN} AS lead_bin, {S.LEAD_BIN_NO} AS lead_bin_no, "
    "coalesce(CAST(customer_type = 'Transient' AS INTEGER), 0) AS is_transient FROM bookings) "
    "WHERE lead_bin IS NOT NULL GROUP BY lead_bin, lead_bin_no, is_transient)"))
def q_lead_transient_rate(spark, sf):
    return st.lead_transient_rate(bookings(spark, sf))


@query("hotel_delta", W(f"SELECT *, cr - overall_cr AS delta_pp FROM (SELECT hotel, {_RATE}, "
                        "(SELECT avg(is_canceled) * 100 FROM bookings) AS overall_cr FROM bookings WHERE hotel IS NOT NULL GROUP BY hotel)"))
def q_hotel_delta(spark, sf):
    return st.hotel_delta(bookings(spark, sf))


@query("rate_vs_overall", W(f"SELECT *, cr - overall_cr AS delta_pp FROM (SELECT market_segment, {_RATE}, "
                            "(SELECT avg(is_canceled) * 100 FROM bookings) AS overall_cr FROM bookings WHERE market_segment IS NOT NULL GROUP BY market_segment)"))
def q_rate_vs_overall(spark, sf):
    b = bookings(spark, sf)
    return st.rate_vs_overall(st.rate_table(b, ["market_segment"]), b)


@query("batch_summary", W("SELECT count(*) AS rows, CAST(sum(prediction) AS BIGINT) AS predicted_cancel, "
                          f"avg(prediction) * 100 AS predicted_cancel_pct FROM ({S.SCORED})"))
def q_batch_summary(spark, sf):
    return st.batch_summary(scored(spark, sf))


@query("risk_mix", W(f"SELECT risk_label, count(*) AS n FROM ({S.SCORED}) WHERE risk_label IS NOT NULL GROUP BY risk_label"))
def q_risk_mix(spark, sf):
    return st.risk_mix(scored(spark, sf))


@query("kpi_summary", W(f"SELECT hotel, avg(is_canceled) * 100 AS cr, avg(lead_time) AS mean_lead_time, "
                        f"avg({S.cents('adr')}) / 100 AS mean_adr, count(*) AS n FROM bookings WHERE hotel IS NOT NULL GROUP BY hotel"))
def q_kpi_summary(spark, sf):
    return st.kpi_summary(bookings(spark, sf))


# user-supplied capacity (rooms, days on sale) per property; example values
CAPACITY = [("City Hotel", 400, 1096), ("Resort Hotel", 200, 1096)]
_CAP_VALUES = ", ".join(f"('{h}', {r}, {d})" for h, r, d in CAPACITY)


@query("revpar", W(
    f"SELECT r.hotel, r.kept, CAST(c.rooms AS BIGINT) AS rooms, CAST(c.days AS BIGINT) AS days, r.revenue_cents / 100 AS revenue, "
    "r.revenue_cents / 100 / (CAST(c.rooms AS BIGINT) * CAST(c.days AS BIGINT)) AS revpar FROM "
    f"(SELECT hotel, CAST(sum({S.cents('adr')} * (stays_in_weekend_nights + stays_in_week_nights)) AS BIGINT) AS revenue_cents, "
    "count(*) AS kept FROM bookings WHERE is_canceled = 0 AND hotel IS NOT NULL GROUP BY hotel) r "
    f"JOIN (VALUES {_CAP_VALUES}) AS c(hotel, rooms, days) ON r.hotel = c.hotel"))
def q_revpar(spark, sf):
    cap = spark.createDataFrame(CAPACITY, "hotel string, rooms long, days long")
    return st.revpar(bookings(spark, sf), cap)


@query("target_distribution", W("SELECT is_canceled, count(*) AS n, count(*) / (SELECT count(*) FROM bookings) AS share "
                                "FROM bookings GROUP BY is_canceled"))
def q_target_distribution(spark, sf):
    return st.target_distribution(bookings(spark, sf))


@query("bivariate_rate", W(
    f"SELECT bin, CAST(min(lead_time) AS DOUBLE) AS lo, CAST(max(lead_time) AS DOUBLE) AS hi, {_RATE} FROM "
    "(SELECT *, 1 + CAST(lead_time > q[1] AS INTEGER) + CAST(lead_time > q[2] AS INTEGER) + CAST(lead_time > q[3] AS INTEGER) AS bin "
    "FROM bookings, (SELECT quantile_cont(lead_time, [0.25, 0.5, 0.75]) AS q FROM bookings) WHERE lead_time IS NOT NULL) GROUP BY bin"))
def q_bivariate_rate(spark, sf):
    return st.bivariate_rate(bookings(spark, sf), "lead_time", 4)


@query("season_rate", W(
    f"SELECT hotel, arrival_season, {_RATE}, CAST(grouping_id(hotel, arrival_season) AS INTEGER) AS level FROM "
    f"(SELECT *, {S.season(S.MONTH_NUM)} AS arrival_season FROM bookings) GROUP BY ROLLUP (hotel, arrival_season)"))
def q_season_rate(spark, sf):
    return st.season_rate(bookings(spark, sf))


# ---------------------------------------------------------------- quality
def _union(parts):
    return " UNION ALL ".join(parts)


_NUM_DOMAIN_SQL = _union(
    f"SELECT '{c}' AS \"column\", {float(lo)} AS lo, {float(hi)} AS hi, (count(*) FILTER (WHERE {c} < {lo})) AS n_below, "
    f"(count(*) FILTER (WHERE {c} > {hi})) AS n_above, (count(*) FILTER (WHERE {c} < {lo})) + (count(*) FILTER (WHERE {c} > {hi})) AS n_out FROM bookings"
    for c, (lo, hi) in NUMERIC_DOMAINS.items())


@query("domain_check_numeric", W(_NUM_DOMAIN_SQL))
def q_domain_check_numeric(spark, sf):
    return qy.domain_check_numeric(bookings(spark, sf))


_CAT_DOMAINS = {**CATEGORY_DOMAINS, "country": COUNTRIES}
_CAT_DOMAIN_SQL = ("SELECT \"column\", value, count(*) AS n FROM (" + _union(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM bookings WHERE NOT coalesce({c} IN ("
    + ", ".join("'" + v + "'" for v in vals) + "), false)" for c, vals in _CAT_DOMAINS.items())
    + ") GROUP BY \"column\", value")


@query("domain_check_category", W(_CAT_DOMAIN_SQL))
def q_domain_check_category(spark, sf):
    return qy.domain_check_category(bookings(spark, sf))


_FENCES = (f"f AS (SELECT hotel, reserved_room_type, quantile_cont({S.cents('adr')}, [0.25, 0.75]) AS q FROM bookings "
           "WHERE adr IS NOT NULL GROUP BY hotel, reserved_room_type), "
           "f2 AS (SELECT hotel, reserved_room_type, q[2] + 1.5 * (q[2] - q[1]) AS fence_cents FROM f), "
           "d AS (SELECT b.*, f2.fence_cents FROM bookings b LEFT JOIN f2 ON b.hotel = f2.hotel AND b.reserved_room_type = f2.reserved_room_type)")
_NIGHTS = "(stays_in_weekend_nights + stays_in_week_nights)"


@query("drop_adr_outliers", W(
    f"SELECT * FROM d WHERE NOT coalesce(adr < 0.0 OR adr > 510.0 OR ({_NIGHTS} = 0 AND adr > 0) "
    f"OR {S.cents('adr')} > fence_cents, false)", _FENCES), as_double=("children",))
def q_drop_adr_outliers(spark, sf):
    return qy.drop_adr_outliers(bookings(spark, sf))


_STEPS = [
    ("has_guests", "adults + coalesce(children, 0) + babies > 0"),
    ("adr_in_domain", "adr BETWEEN 0.0 AND 510.0"),
    ("rate_needs_nights", f"NOT ({_NIGHTS} = 0 AND adr > 0)"),
    ("adr_under_fence", f"coalesce({S.cents('adr')} <= fence_cents, true)"),
]


def _cleaning_sql():
    cum, aggs = "true", []
    for i, (_, pred) in enumerate(_STEPS):
        aggs.append(f"(count(*) FILTER (WHERE {cum})) AS in{i}")
        cum = f"{cum} AND coalesce({pred}, false)"
        aggs.append(f"(count(*) FILTER (WHERE {cum})) AS out{i}")
    body = _union(f"SELECT '{n}' AS step, {i + 1} AS step_no, in{i} AS rows_in, out{i} AS rows_out, "
                  f"in{i} - out{i} AS dropped FROM a" for i, (n, _) in enumerate(_STEPS))
    return W(body, _FENCES + f", a AS (SELECT {', '.join(aggs)} FROM d)")


@query("cleaning_log", _cleaning_sql())
def q_cleaning_log(spark, sf):
    return qy.cleaning_log(bookings(spark, sf))


_ALL_COLS = ["booking_id", "hotel", "is_canceled", "lead_time", "arrival_date_month",
             "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children", "babies",
             "meal", "country", "market_segment", "distribution_channel", "is_repeated_guest",
             "previous_cancellations", "previous_bookings_not_canceled", "reserved_room_type",
             "booking_changes", "deposit_type", "agent", "company", "days_in_waiting_list",
             "customer_type", "adr", "required_car_parking_spaces", "total_of_special_requests",
             "score"]


@query("missing_profile", W(_union(
    f"SELECT '{c}' AS \"column\", (count(*) FILTER (WHERE {c} IS NULL)) AS n_null, (count(*) FILTER (WHERE {c} IS NULL)) / count(*) * 100 AS null_pct FROM bookings"
    for c in _ALL_COLS)))
def q_missing_profile(spark, sf):
    return qy.missing_profile(bookings(spark, sf))


def _num_x(c):
    return f"CAST({S.cents(c)} AS DOUBLE)" if c in qy.MONEY_COLUMNS else f"CAST({c} AS DOUBLE)"


def _num_s(c):
    return "100.0" if c in qy.MONEY_COLUMNS else "1.0"


@query("numeric_profile", W(_union(
    f"SELECT '{c}' AS \"column\", count(x) AS n, avg(x) / {_num_s(c)} AS mean, {S.stable(f'stddev_samp(x) / {_num_s(c)}')} AS sd, "
    f"min(x) / {_num_s(c)} AS min, quantile_cont(x, 0.25) / {_num_s(c)} AS q1, quantile_cont(x, 0.5) / {_num_s(c)} AS median, "
    f"quantile_cont(x, 0.75) / {_num_s(c)} AS q3, max(x) / {_num_s(c)} AS max, (count(*) FILTER (WHERE x = 0)) / nullif(count(x), 0) AS zero_share "
    f"FROM (SELECT {_num_x(c)} AS x FROM bookings)" for c in qy.NUMERIC_PROFILE_COLUMNS)))
def q_numeric_profile(spark, sf):
    return qy.numeric_profile(bookings(spark, sf))


@query("outlier_profile", W(_union(
    f"SELECT '{c}' AS \"column\", q1 / {_num_s(c)} AS q1, q3 / {_num_s(c)} AS q3, lo / {_num_s(c)} AS lo_fence, hi / {_num_s(c)} AS hi_fence, "
    "n_below, n_above FROM (SELECT q1, q3, lo, hi, (SELECT (count(*) FILTER (WHERE x < lo)) FROM t) AS n_below, (SELECT (count(*) FILTER (WHERE x > hi)) FROM t) AS n_above "
    "FROM (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    "(SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM t)))".replace(
        "FROM t", f"FROM (SELECT {_num_x(c)} AS x FROM bookings)")
    for c in qy.NUMERIC_PROFILE_COLUMNS)))
def q_outlier_profile(spark, sf):
    return qy.outlier_profile(bookings(spark, sf))


@query("category_profile", W(
    "SELECT \"column\", value, n, n / sum(n) OVER (PARTITION BY \"column\") AS share FROM (SELECT \"column\", value, count(*) AS n FROM ("
    + _union(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM bookings" for c in qy.CATEGORY_PROFILE_COLUMNS)
    + ") WHERE value IS NOT NULL GROUP BY \"column\", value)"))
def q_category_profile(spark, sf):
    return qy.category_profile(bookings(spark, sf))


_CC = qy.CORRELATION_COLUMNS


@query("correlation", W(_union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {S.stable(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS r FROM bookings"
    for i, a in enumerate(_CC) for b in _CC[i + 1:])))
def q_correlation(spark, sf):
    return qy.correlation(bookings(spark, sf))


@query("leakage_scan", W(
    "SELECT \"column\", value, avg(y) AS rate, count(y) AS n FROM ("
    + _union(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, is_canceled AS y FROM bookings"
             for c in qy.CATEGORY_PROFILE_COLUMNS)
    + ") WHERE value IS NOT NULL GROUP BY \"column\", value HAVING count(y) >= 200 AND (avg(y) <= 0.02 OR avg(y) >= 0.98)"))
def q_leakage_scan(spark, sf):
    return qy.leakage_scan(bookings(spark, sf))
