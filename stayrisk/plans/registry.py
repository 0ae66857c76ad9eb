"""Name -> (Spark query, DuckDB twin) registry used by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, as_double: tuple = ()):
    """Register a query; ``sql`` is its DuckDB twin (None = rows-only check).

    ``as_double`` names integer columns that hold NULLs: both sides present
    them as DOUBLE (what pandas does with an integer column holding NaN), so
    a pandas-based comparison sees the same dtype on both sides.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        if as_double:
            from pyspark.sql import functions as F

            def wrapped(spark, sf, _fn=fn):
                df = _fn(spark, sf)
                return df.withColumns({c: F.col(c).cast("double") for c in as_double})
            wrapped.__name__ = fn.__name__
            wrapped.__doc__ = fn.__doc__
            QUERIES[name] = wrapped
        else:
            QUERIES[name] = fn
        if sql is not None:
            text = sql
            if as_double:
                rep = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in as_double)
                text = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n)"
            ORACLE[name] = text
        return fn
    return deco
