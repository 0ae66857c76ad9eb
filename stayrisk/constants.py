"""Fixed values that must equal the reference application's for equal results.

Everything in this module is stated as plain text, in natural order.
"""

# --- fixed values: calendar -------------------------------------------------
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
# month number -> season (Dec/Jan/Feb winter, Mar-May spring, Jun-Aug summer, Sep-Nov fall)
SEASON_OF_MONTH = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Fall", 10: "Fall", 11: "Fall",
}

# --- fixed values: country whitelist (36 countries plus the literal "Other") --
COUNTRIES = [
    "AGO", "ARG", "AUS", "AUT", "BEL", "BRA", "CHE", "CHN",
    "CZE", "DEU", "DNK", "DZA", "ESP", "FIN", "FRA", "GBR",
    "GRC", "HRV", "HUN", "IND", "IRL", "ISR", "ITA", "JPN",
    "KOR", "LUX", "MAR", "NLD", "NOR", "Other", "POL", "PRT",
    "ROU", "RUS", "SWE", "TUR", "USA",
]

# --- fixed values: decision threshold and cuts ------------------------------
THRESHOLD = 0.60
# lead-time bins: right-closed edges -1, 7, 30, 90, 180, 709; outside -> null
LEAD_EDGES = [-1, 7, 30, 90, 180, 709]
LEAD_LABELS = ["0–7", "8–30", "31–90", "91–180", "181+"]
# batch risk label: right-closed cuts -0.01, 0.40, 0.65, 1.01
RISK_EDGES = [-0.01, 0.40, 0.65, 1.01]
RISK_LABELS = ["low", "medium", "high"]
# gauge colour: left-closed, >= 0.65 red, >= 0.40 amber, else green
GAUGE_RED, GAUGE_AMBER = 0.65, 0.40
# advice grade for a predicted cancel: very high from 0.75; medium from 0.40
ADVICE_VERY_HIGH, ADVICE_MEDIUM = 0.75, 0.40
ADVICE_ACTIONS = {
    "very_high": [
        "Contact the guest to reconfirm right away",
        "Offer a retention incentive (room upgrade, F&B voucher)",
        "Switch on the overbooking / room re-sell strategy",
    ],
    "high": [
        "Watch the booking more closely",
        "Send a confirmation reminder 48 hours before check-in",
        "Prepare a replacement from the waitlist",
    ],
    "medium": ["Monitor; send the standard confirmation"],
    "low": ["Booking looks stable"],
}
# rate bands for the dashboard (percent): red from 35; amber from 28 (month) / 25 (lead)
BAND_RED = 35.0
BAND_AMBER_MONTH = 28.0
BAND_AMBER_LEAD = 25.0
MIN_SUPPORT = 200
TOP_K = 10

# --- fixed values: cost analysis --------------------------------------------
COST_FP = 700
COST_FN = 300
COST_GRID = (100, 2000, 50)   # slider min, max, step for both costs

# --- fixed values: feature set (29 columns, in model order) -----------------
FEATURE_COLUMNS = [
    "hotel", "lead_time", "stays_in_weekend_nights", "stays_in_week_nights",
    "adults", "meal", "market_segment", "distribution_channel",
    "is_repeated_guest", "reserved_room_type", "agent", "company",
    "days_in_waiting_list", "customer_type", "adr", "total_of_special_requests",
    "country_grouped", "arrival_season", "month_sin", "month_cos",
    "babies_bin", "children_bin", "parking_bin",
    "prev_cancel_bin", "prev_loyal_bin", "booking_changes_bin",
    "no_commitment", "lead_x_transient", "is_weekend_only",
]

# --- fixed values: batch input contract --------------------------------------
CONTRACT_COLUMNS = [
    "hotel", "lead_time", "arrival_date_month", "stays_in_weekend_nights",
    "stays_in_week_nights", "adults", "children", "babies", "meal",
    "market_segment", "distribution_channel", "is_repeated_guest",
    "reserved_room_type", "agent", "days_in_waiting_list", "customer_type",
    "adr", "total_of_special_requests", "country",
    "required_car_parking_spaces", "previous_cancellations",
    "previous_bookings_not_canceled", "booking_changes",
]
# read directly by the feature step: a missing one is an error
HARD_REQUIRED = [
    "arrival_date_month", "lead_time", "customer_type", "stays_in_week_nights",
    "stays_in_weekend_nights", "babies", "children", "required_car_parking_spaces",
    "previous_cancellations", "previous_bookings_not_canceled", "booking_changes",
    "total_of_special_requests",
]

# --- fixed values: form domains (numeric min/max, category option lists) ----
NUMERIC_DOMAINS = {
    "lead_time": (0, 709),
    "days_in_waiting_list": (0, 180),
    "stays_in_weekend_nights": (0, 10),
    "stays_in_week_nights": (0, 21),
    "adults": (1, 10),
    "adr": (0.0, 510.0),
    "total_of_special_requests": (0, 5),
    "agent": (0, 535),
    "company": (0, 543),
}
CATEGORY_DOMAINS = {
    "hotel": ["City Hotel", "Resort Hotel"],
    "reserved_room_type": ["A", "B", "C", "D", "E", "F", "G", "H", "L"],
    "meal": ["BB", "HB", "FB", "SC"],
    "market_segment": ["Online TA", "Offline TA/TO", "Direct", "Corporate",
                       "Groups", "Complementary", "Aviation"],
    "distribution_channel": ["TA/TO", "Direct", "Corporate", "GDS"],
    "customer_type": ["Transient", "Transient-Party", "Contract", "Group"],
}

# --- fixed values: CSV tokens read as null (pandas read_csv defaults) -------
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
