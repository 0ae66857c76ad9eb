"""DuckDB expressions mirroring the column functions, for the SQL twins."""

from ..constants import COUNTRIES, MONTHS

MONTH_CASE = ("CASE arrival_date_month " + " ".join(
    f"WHEN '{m}' THEN {i}" for i, m in enumerate(MONTHS, start=1)) + " END")
MONTH_NUM = f"coalesce({MONTH_CASE}, 1)"


def season(m: str) -> str:
    return (f"CASE WHEN {m} IN (12,1,2) THEN 'Winter' WHEN {m} IN (3,4,5) THEN 'Spring' "
            f"WHEN {m} IN (6,7,8) THEN 'Summer' WHEN {m} IN (9,10,11) THEN 'Fall' END")


def stable(x: str, d: int = 9) -> str:
    return f"(round({x}, {d}) + 0.0)"


COUNTRY_LIST = ", ".join(f"'{c}'" for c in COUNTRIES)
COUNTRY_GROUPED = f"CASE WHEN country IN ({COUNTRY_LIST}) THEN country ELSE 'Other' END"
LEAD_X_TRANSIENT = ("coalesce(lead_time, 0) * coalesce(CAST(customer_type = 'Transient' AS INTEGER), 0)")
IS_WEEKEND_ONLY = ("CAST(coalesce(stays_in_week_nights, 0) = 0 AND coalesce(stays_in_weekend_nights, 0) > 0 AS INTEGER)")
BABIES_BIN = "CASE WHEN coalesce(babies, 0) > 0 THEN 'has_baby' ELSE 'no_baby' END"
CHILDREN_BIN = "CASE WHEN coalesce(children, 0) > 0 THEN 'has_children' ELSE 'no_children' END"
PARKING_BIN = "CASE WHEN coalesce(required_car_parking_spaces, 0) > 0 THEN 'has_parking' ELSE 'no_parking' END"
PREV_CANCEL_BIN = ("CASE WHEN coalesce(previous_cancellations, 0) = 0 THEN 'never' "
                   "WHEN coalesce(previous_cancellations, 0) = 1 THEN 'once' ELSE 'multiple' END")
PREV_LOYAL_BIN = ("CASE WHEN coalesce(previous_bookings_not_canceled, 0) = 0 THEN 'none' "
                  "WHEN coalesce(previous_bookings_not_canceled, 0) <= 3 THEN 'some' ELSE 'many' END")
CHANGES_BIN = ("CASE WHEN coalesce(booking_changes, 0) = 0 THEN 'none' "
               "WHEN coalesce(booking_changes, 0) <= 2 THEN 'some' ELSE 'many' END")
NO_COMMITMENT = ("CAST(coalesce(required_car_parking_spaces, 0) = 0 AND "
                 "coalesce(total_of_special_requests, 0) = 0 AS INTEGER)")
LEAD_BIN = ("CASE WHEN lead_time > -1 AND lead_time <= 7 THEN '0–7' "
            "WHEN lead_time > 7 AND lead_time <= 30 THEN '8–30' "
            "WHEN lead_time > 30 AND lead_time <= 90 THEN '31–90' "
            "WHEN lead_time > 90 AND lead_time <= 180 THEN '91–180' "
            "WHEN lead_time > 180 AND lead_time <= 709 THEN '181+' END")
LEAD_BIN_NO = ("CASE WHEN lead_time > -1 AND lead_time <= 7 THEN 1 "
               "WHEN lead_time > 7 AND lead_time <= 30 THEN 2 "
               "WHEN lead_time > 30 AND lead_time <= 90 THEN 3 "
               "WHEN lead_time > 90 AND lead_time <= 180 THEN 4 "
               "WHEN lead_time > 180 AND lead_time <= 709 THEN 5 END")


def risk_label(p: str) -> str:
    return (f"CASE WHEN {p} > -0.01 AND {p} <= 0.40 THEN 'low' WHEN {p} > 0.40 AND {p} <= 0.65 "
            f"THEN 'medium' WHEN {p} > 0.65 AND {p} <= 1.01 THEN 'high' END")


def prob_round(p: str) -> str:
    return f"(round_even({p} * 10000.0, 0) / 10000.0)"


def decision(p: str, t: float = 0.60) -> str:
    return f"CAST({p} >= {t} AS INTEGER)"


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


SCORED = (f"SELECT *, {prob_round('score')} AS cancel_probability, {decision('score')} AS prediction, "
          f"{risk_label('score')} AS risk_label FROM bookings")
