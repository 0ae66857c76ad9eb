"""Skew: one customer owns a third of the orders, at any time of the day and
with ids in no order of time.  The balanced bookings build must equal the plain
per-customer window, and no window of it may hold more than a sliver of the hot
customer's rows."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from stayrisk.sources.bookings import bookings_plan, history_levels


def _id(k):
    """Ids over several blocks of 2^16 and two of 2^32, in no order of time."""
    return (k * 7919) % 3001 * 4001 + (k % 2 << 33)


def _skewed_tables(spark):
    rnd = random.Random(5)
    d = tempfile.mkdtemp(prefix="stayrisk-skew-")
    customers = [(c, f"C{c}", c % 25, 100.0, ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"][c % 5])
                 for c in range(1, 101)]
    orders, lines = [], []
    base = dt.datetime(1995, 1, 1)
    for k in range(3000):
        cust = 7 if k % 3 == 0 else rnd.randint(1, 100)
        day = base + dt.timedelta(days=rnd.randint(0, 400), seconds=rnd.choice([0, rnd.randint(0, 86399)]))
        orders.append((_id(k), cust, "O", float(rnd.randint(1000, 400000)) + 0.25, day, "1-URGENT"))
        for ln in range(1, rnd.randint(1, 4) + 1):
            lines.append((_id(k), 1, 1, ln, float(rnd.randint(1, 50)), 10.0, 0.05, 0.01, rnd.choice("RNA"), "O", day))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                  "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                                     "c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                 "l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_hot_customer_balanced_and_equal(spark):
    d = _skewed_tables(spark)
    b = bookings_plan(spark, d, use_sql_window=True)
    for rows in (100, 1 << 20):                  # the hot customer split, and not
        a = bookings_plan(spark, d, checkpoint=True, window_rows=rows)
        assert a.count() == b.count() == 3000
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_window_holds_much_of_the_hot_customer(spark):
    d = _skewed_tables(spark)
    o = spark.read.parquet(f"{d}/orders.parquet").filter("o_custkey = 7").select(
        F.col("o_orderkey").alias("booking_id"), F.col("o_orderdate").alias("od"))
    o = o.withColumns(history_levels())
    names, hot_rows = list(history_levels()), o.count()
    assert hot_rows >= 1000                      # a third of all orders, plus chance hits
    assert o.groupBy(*names).count().agg(F.max("count")).first()[0] <= 0.02 * hot_rows
    for k in range(1, len(names)):               # children of one block
        kids = o.select(*names[:k + 1]).distinct().groupBy(*names[:k]).count().agg(F.max("count")).first()[0]
        assert kids <= 0.05 * hot_rows
    days = o.select("_day").distinct().count()   # the top window has a row per day
    assert days <= 401
