"""The bookings table: balanced windows == the SQL text in Spark and DuckDB."""

import duckdb

from stayrisk.sources.bookings import BOOKINGS_SQL, bookings, bookings_plan


def test_balanced_equals_sql(spark, sf):
    a = bookings_plan(spark, sf).toPandas().sort_values("booking_id").reset_index(drop=True)
    b = bookings_plan(spark, sf, use_sql_window=True).toPandas().sort_values("booking_id").reset_index(drop=True)
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    c = con.sql(BOOKINGS_SQL).df().sort_values("booking_id").reset_index(drop=True)
    assert len(a) == len(b) == len(c) == 1500
    for col in a.columns:
        for other in (b, c):
            x, y = a[col], other[col]
            assert ((x == y) | (x.isna() & y.isna())).all(), col


def test_materialized_is_reused(spark, sf):
    p1 = bookings(spark, sf).inputFiles()
    p2 = bookings(spark, sf).inputFiles()
    assert p1 == p2


def test_rebuilds_when_folder_is_gone(spark, sf):
    from stayrisk.sources import bookings as B
    n = B.bookings(spark, sf).count()
    key = next(k for k in B._MATERIALIZED if k[1].endswith("sf0.001"))
    B._MATERIALIZED[key] = B._MATERIALIZED[key] + "-missing"     # as if cleaned up
    assert B.bookings(spark, sf).count() == n
    assert not B._MATERIALIZED[key].endswith("-missing")


def test_one_exchange_of_few_columns_by_customer(spark, sf):
    """Rows are dealt by customer once, as the columns that all others are
    derived from, and nothing is written or dealt again before the window."""
    plan = bookings_plan(spark, sf, checkpoint=True)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    dealt = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "custkey" in x.lower() and "o_custkey" in x]
    assert len(dealt) == 1 and "REPARTITION_BY_COL" in dealt[0]
    assert not any("Exchange hashpartitioning(cust" in x for x in text.splitlines())
    assert "history-" not in text
