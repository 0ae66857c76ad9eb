"""The ``bookings`` table: one row per order, derived from the driver tables.

The definition is one SQL text (FIXTURES.md §2).  DuckDB runs it whole as a
CTE.  Spark runs the same text up to ``b3``, with the lines joined first and one
exchange by customer of the few columns that all others are derived from; the
join with customers, the derived columns and the per-customer window of ``b4``
follow in the same tasks.  Customers above ``WINDOW_ROWS`` orders leave the window
for a :func:`nested_running_sum`, so a customer with a huge share of the orders is
spread over many tasks.  All give identical integer counts (tested).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.prefix import nested_running_sum
from ..session import shared_dir

_BASE_CTES = """l AS (SELECT l_orderkey, count(*) AS n_lines, CAST(floor(sum(l_quantity)) AS BIGINT) AS qty,
            sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n_ret
           FROM lineitem GROUP BY l_orderkey),
b0 AS (SELECT o.o_orderkey AS booking_id, o.o_custkey AS cust, o.o_orderdate AS od,
         (o.o_orderkey*7919 + 17) % 10007 AS h1, (o.o_orderkey*104729 + 31) % 10009 AS h2,
         (o.o_custkey*15485863 + 7) % 10037 AS h3,
         c.c_nationkey AS nk, c.c_mktsegment AS seg, o.o_orderpriority AS prio,
         coalesce(l.n_lines,0) AS n_lines, coalesce(l.qty,0) AS qty, coalesce(l.n_ret,0) AS n_ret,
         o.o_totalprice AS price
       FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey LEFT JOIN l ON o.o_orderkey=l.l_orderkey),
b1 AS (SELECT booking_id, cust, od, h1, h2, h3, n_lines, n_ret,
  CASE WHEN h1 % 3 = 0 THEN 'Resort Hotel' ELSE 'City Hotel' END AS hotel,
  CAST(floor((h1 % 740) * (h2 % 740) / 740) AS INT) AS lead_time,
  CAST(month(od) AS INT) AS m,
  CAST(h2 % 3 AS INT) AS stays_in_weekend_nights,
  CAST(qty % 6 AS INT) AS stays_in_week_nights,
  CAST(1 + h3 % 3 AS INT) AS adults,
  CASE WHEN h1 % 500 = 0 THEN NULL ELSE CAST(CASE WHEN h3 % 9 = 0 THEN 1 + h3 % 2 ELSE 0 END AS INT) END AS children,
  CAST(CASE WHEN h2 % 60 = 0 THEN 1 ELSE 0 END AS INT) AS babies,
  CASE WHEN h2 % 20 = 0 THEN 'FB' WHEN h2 % 7 = 0 THEN 'HB' WHEN h2 % 5 = 0 THEN 'SC' ELSE 'BB' END AS meal,
  CASE WHEN h3 % 100 = 0 THEN NULL WHEN nk=0 THEN 'PRT' WHEN nk=1 THEN 'GBR' WHEN nk=2 THEN 'FRA' WHEN nk=3 THEN 'ESP' WHEN nk=4 THEN 'DEU' WHEN nk=5 THEN 'ITA'
       WHEN nk=6 THEN 'IRL' WHEN nk=7 THEN 'BEL' WHEN nk=8 THEN 'BRA' WHEN nk=9 THEN 'NLD' WHEN nk=10 THEN 'USA' WHEN nk=11 THEN 'CHE' WHEN nk=12 THEN 'CHN'
       WHEN nk=13 THEN 'AUT' WHEN nk=14 THEN 'SWE' WHEN nk=15 THEN 'POL' ELSE concat('X', CAST(nk AS VARCHAR(4))) END AS country,
  CASE seg WHEN 'AUTOMOBILE' THEN 'Online TA' WHEN 'BUILDING' THEN 'Offline TA/TO' WHEN 'FURNITURE' THEN 'Direct' WHEN 'MACHINERY' THEN 'Corporate' ELSE 'Groups' END AS market_segment,
  CASE WHEN seg IN ('AUTOMOBILE','BUILDING') THEN 'TA/TO' WHEN seg='FURNITURE' THEN 'Direct' WHEN seg='MACHINERY' THEN 'Corporate' ELSE 'GDS' END AS distribution_channel,
  substr('ABCDEFGHL', CAST(1 + h2 % 9 AS INT), 1) AS reserved_room_type,
  CASE WHEN h2 % 7 = 0 THEN NULL ELSE CAST(h3 % 60 AS DOUBLE) END AS agent,
  CASE WHEN h1 % 10 = 0 THEN CAST(h3 % 40 AS DOUBLE) ELSE NULL END AS company,
  CAST(CASE WHEN h1 % 25 = 0 THEN h2 % 181 ELSE 0 END AS INT) AS days_in_waiting_list,
  CASE WHEN h3 % 20 = 0 THEN 'Contract' WHEN h3 % 50 = 1 THEN 'Group' WHEN h3 % 5 = 2 THEN 'Transient-Party' ELSE 'Transient' END AS customer_type,
  CAST(CAST(floor(price) AS BIGINT) % 52000 AS DOUBLE) / 100 AS adr,
  CAST(CASE WHEN h2 % 12 = 0 THEN 1 ELSE 0 END AS INT) AS required_car_parking_spaces,
  CAST(CASE WHEN h1 % 2 = 0 THEN 0 ELSE h1 % 6 END AS INT) AS total_of_special_requests,
  CAST(CASE WHEN h2 % 6 = 0 THEN 1 + h1 % 4 ELSE 0 END AS INT) AS booking_changes
  FROM b0),
b2 AS (SELECT *, LEAST(95, GREATEST(0,
     12 + CAST(floor(lead_time / 15) AS INT) * CASE WHEN customer_type='Transient' THEN 2 ELSE 1 END
     + CASE WHEN market_segment='Groups' THEN 12 WHEN market_segment='Online TA' THEN 6 WHEN market_segment='Direct' THEN -6 ELSE 0 END
     + CASE WHEN country='PRT' THEN 18 WHEN country IN ('DEU','FRA') THEN -6 ELSE 0 END
     + CASE WHEN required_car_parking_spaces=0 AND total_of_special_requests=0 THEN 14 ELSE -4 END
     - CASE WHEN required_car_parking_spaces>0 THEN 90 ELSE 0 END)) AS pct FROM b1),
b3 AS (SELECT *, CAST(CASE WHEN (h1*31 + h2*17) % 100 < pct THEN 1 ELSE 0 END AS INT) AS is_canceled FROM b2)"""

_WINDOW_CTE = """b4 AS (SELECT *, CAST(coalesce(sum(is_canceled) OVER w,0) AS INT) AS previous_cancellations,
        CAST(coalesce(sum(1-is_canceled) OVER w,0) AS INT) AS previous_bookings_not_canceled
       FROM b3 WINDOW w AS (PARTITION BY cust ORDER BY od, booking_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_FINAL_SELECT = """SELECT booking_id, hotel, is_canceled, lead_time,
  CASE m WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July'
    WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS arrival_date_month,
  stays_in_weekend_nights, stays_in_week_nights, adults, children, babies, meal, country, market_segment, distribution_channel,
  CAST(CASE WHEN previous_bookings_not_canceled>=3 THEN 1 ELSE 0 END AS INT) AS is_repeated_guest,
  previous_cancellations, previous_bookings_not_canceled, reserved_room_type, booking_changes,
  CASE WHEN is_canceled=1 AND h1 % 3 = 1 THEN 'Non Refund' WHEN h2 % 90 = 0 THEN 'Refundable' ELSE 'No Deposit' END AS deposit_type,
  agent, company, days_in_waiting_list, customer_type, adr, required_car_parking_spaces, total_of_special_requests,
  CAST((pct*3 + h3 % 40) AS DOUBLE) / 325 AS score
FROM b4"""

# The one definition, as DuckDB (and Spark SQL) run it whole.
BOOKINGS_SQL = "WITH " + _BASE_CTES + ",\n" + _WINDOW_CTE + "\n" + _FINAL_SELECT

DRIVER_TABLES = ("orders", "customer", "lineitem")

# orders of one customer that one window task may hold
WINDOW_ROWS = 1 << 20


def register_driver_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, str]:
    """Register the driver tables under session-unique view names (a user's
    own ``orders`` view is left alone); returns table -> view name."""
    tag = uuid.uuid4().hex[:8]
    views = {}
    for t in names:
        views[t] = f"_stayrisk_{t}_{tag}"
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(views[t])
    return views


def _with_views(sql: str, views: dict[str, str]) -> str:
    """The bookings SQL text with table names pointed at the given views."""
    for t, v in views.items():
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {v}", sql)
    return sql


def history_levels() -> dict:
    """Blocks along (od, booking_id): day, minute, exact time, then id ranges.
    No block has more children than there are days, 1440 minutes, distinct
    times in a minute, or 2^16 id ranges; a leaf holds at most 2^16 ids."""
    od = F.col("od").cast("timestamp")
    return {"_day": F.to_date(od), "_minute": F.date_trunc("minute", od), "_time": od,
            "_id32": F.shiftright("booking_id", 32), "_id16": F.shiftright("booking_id", 16)}


def _history_values() -> dict:
    return {"previous_cancellations": F.col("is_canceled"),
            "previous_bookings_not_canceled": F.lit(1) - F.col("is_canceled")}


def _by_customer(ctes: str) -> str:
    """The base text with an order's lines joined before its customer and the
    joined rows dealt by customer: the same rows, one exchange of few columns."""
    for old, new in (("FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey LEFT JOIN l ON o.o_orderkey=l.l_orderkey",
                      "FROM (SELECT /*+ REPARTITION(o_custkey) */ o.*, l.n_lines, l.qty, l.n_ret "
                      "FROM orders o LEFT JOIN l ON o.o_orderkey=l.l_orderkey) o JOIN customer c ON o.o_custkey=c.c_custkey"),
                     ("coalesce(l.", "coalesce(o.")):
        if old not in ctes:
            raise ValueError(f"not in the bookings text: {old}")
        ctes = ctes.replace(old, new)
    return ctes


def _base(spark: SparkSession, ctes: str, views: dict[str, str]) -> DataFrame:
    # only what the final projection reads: lets Catalyst prune the unused
    # lineitem aggregates before rows are dealt or written
    return spark.sql(_with_views("WITH " + ctes + " SELECT * FROM b3", views)).drop("n_lines", "n_ret")


def _light_history(b3: DataFrame) -> DataFrame:
    """Cancelled and kept orders of the same customer before each order, by
    (od, booking_id), in one window per customer."""
    w = Window.partitionBy("cust").orderBy("od", "booking_id").rowsBetween(Window.unboundedPreceding, -1)
    return b3.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in _history_values().items()})


def _heavy_history(b3: DataFrame) -> DataFrame:
    """The same for customers of any number of orders.  ``b3`` is read twice:
    pass a written table."""
    return nested_running_sum(b3, ["cust"], [F.col("od"), F.col("booking_id")], history_levels(), _history_values())


def bookings_plan(spark: SparkSession, sf_dir: str, use_sql_window: bool = False,
                  checkpoint: bool = False, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Bookings DataFrame.

    ``checkpoint=True`` writes the joined rows of customers above ``window_rows``
    orders once to the shared checkpoint folder before the running sums (they are
    read more than once).  ``use_sql_window=True`` runs the SQL text whole (single
    window per customer); it exists to test the balanced version against it.
    """
    views = register_driver_tables(spark, sf_dir)
    orders = spark.table(views["orders"])
    made = []

    def over(rows: DataFrame) -> dict[str, str]:
        """The driver tables' views with ``rows`` as the orders."""
        made.append(f"{views['orders']}_{len(made)}")
        rows.createOrReplaceTempView(made[-1])
        return {**views, "orders": made[-1]}

    try:
        if use_sql_window:
            return spark.sql(_with_views(BOOKINGS_SQL, views))
        # at most one customer per window_rows orders
        heavy = F.broadcast(orders.groupBy("o_custkey").count().filter(F.col("count") > window_rows).select("o_custkey"))
        if heavy.isEmpty():
            b4 = _light_history(_base(spark, _by_customer(_BASE_CTES), views))
        else:
            light = _base(spark, _by_customer(_BASE_CTES), over(orders.join(heavy, "o_custkey", "left_anti")))
            large = _base(spark, _BASE_CTES, over(orders.join(heavy, "o_custkey", "left_semi")))
            if checkpoint:
                path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex[:12]}"
                large.write.parquet(path)
                large = spark.read.parquet(path)
            b4 = _light_history(light).unionByName(_heavy_history(large))
    finally:
        for v in (*views.values(), *made):
            spark.catalog.dropTempView(v)
    view = f"b4_{uuid.uuid4().hex[:8]}"
    b4.withColumns({k: F.col(k).cast("int") for k in _history_values()}).createOrReplaceTempView(view)
    try:
        return spark.sql(_FINAL_SELECT.replace("FROM b4", f"FROM {view}"))
    finally:
        spark.catalog.dropTempView(view)


_MATERIALIZED: dict[tuple, str] = {}


def source_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the source files: a changed source is built anew."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for t in DRIVER_TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            out += [(t, f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(out)


def _cache_key(spark: SparkSession, sf_dir: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), source_stamp(spark, sf_dir))


def bookings_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the written bookings table (written on first use)."""
    bookings(spark, sf_dir)
    return _MATERIALIZED[_cache_key(spark, sf_dir)]


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bookings table, written once per session and source to the shared
    folder (``spark.checkpoint.dir``) and read back.

    Writing cuts the lineage (a lost executor re-reads parquet instead of
    re-running the joins and windows) and lets many reports share one scan.
    """
    key = _cache_key(spark, sf_dir)
    path = _MATERIALIZED.get(key)
    if path is not None:
        try:
            return spark.read.parquet(path)
        except Exception:  # noqa: BLE001 - the folder was cleaned up: rebuild
            _MATERIALIZED.pop(key, None)
    path = f"{shared_dir(spark)}/bookings-{uuid.uuid4().hex[:12]}"
    bookings_plan(spark, sf_dir, checkpoint=True).write.mode("overwrite").parquet(path)
    _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def duckdb_with_bookings(body: str, extra_ctes: str = "") -> str:
    """Prefix a DuckDB query with the bookings CTE (and optional more CTEs)."""
    ctes = f"bookings AS ({BOOKINGS_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"
