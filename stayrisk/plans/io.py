"""Registered queries: sources, sinks, batch scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features as fx
from ..operators.quality import drop_leaky
from ..session import shared_dir
from ..sources import files
from ..sources.bookings import bookings, duckdb_with_bookings as W
from . import sql_snippets as S
from .dashboard import scored
from .registry import query

_WRITTEN: dict[tuple, str] = {}


def _once(spark, sf, kind, writer):
    """Write a derived file set once per session and source; return its path."""
    key = (spark.sparkContext.applicationId, sf, kind)
    path = _WRITTEN.get(key)
    if path is not None:
        try:
            spark.read.parquet(path) if kind != "bookings-csv" else spark.read.text(path)
            return path
        except Exception:  # noqa: BLE001 - the folder was cleaned up: write again
            _WRITTEN.pop(key, None)
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex[:12]}"
    writer(path)
    _WRITTEN[key] = path
    return path


def bookings_csv(spark, sf):
    return _once(spark, sf, "bookings-csv", lambda p: files.write_with_null_tokens(bookings(spark, sf), p))


@query("scan_bookings", W("SELECT * FROM bookings"), as_double=("children",))
def q_scan_bookings(spark, sf):
    return files.scan_bookings(spark, bookings_csv(spark, sf))


@query("scan_batch", W("SELECT count(*) AS n_rows FROM bookings"))
def q_scan_batch(spark, sf):
    df = files.scan_csv(spark, bookings_csv(spark, sf), with_file=True)
    return files.file_row_counts(df).agg(F.sum("rows").alias("n_rows"))


def _kinds_sql(f):
    """Type and number of values of a column as the CSV spells them."""
    v = f"CAST({f.name} AS VARCHAR)"
    if isinstance(f.dataType, T.IntegerType):
        v = f"CASE WHEN booking_id % 3 = 0 THEN {v} || '.0' ELSE {v} END"
    bare = lambda p: p.strip("^$")
    kind = (f"CASE WHEN v IS NULL THEN 0 WHEN regexp_full_match(v, '{bare(files.INT_PATTERN)}') THEN 1 "
            f"WHEN regexp_full_match(v, '{bare(files.DOUBLE_PATTERN)}') THEN 2 WHEN v IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false') THEN 4 "
            f"WHEN regexp_full_match(v, '{bare(files.DATE_PATTERN)}') AND TRY_CAST(v AS DATE) IS NOT NULL THEN 8 ELSE 16 END")
    return (f"SELECT '{f.name}' AS \"column\", CASE bit_or({kind}) WHEN 1 THEN 'bigint' WHEN 2 THEN 'double' WHEN 3 THEN 'double' "
            f"WHEN 4 THEN 'boolean' WHEN 8 THEN 'date' ELSE 'string' END AS type, count(v) AS n_values FROM (SELECT {v} AS v FROM bookings)")


@query("infer_types", W(" UNION ALL ".join(_kinds_sql(f) for f in files.BOOKING_SCHEMA.fields)))
def q_infer_types(spark, sf):
    """A01/A02 without a schema: types of the CSV's columns from all values."""
    return files.infer_types(files.scan_text(spark, bookings_csv(spark, sf)))


_WHOLE = [f.name for f in files.BOOKING_SCHEMA.fields if isinstance(f.dataType, T.IntegerType)]


@query("scan_inferred", W("SELECT * REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _WHOLE) + ") FROM bookings"))
def q_scan_inferred(spark, sf):
    """The CSV read with inferred types; whole numbers that some rows write with
    a fraction are doubles."""
    return files.scan_inferred(spark, bookings_csv(spark, sf))


@query("scored_batches", W(f"SELECT *, CASE WHEN booking_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM ({S.SCORED})"), as_double=("children",))
def q_scored_batches(spark, sf):
    """A04 batch by batch: one of them first written with other rows, then again."""
    root = f"{shared_dir(spark)}/scored-batches-{uuid.uuid4().hex[:12]}"
    d = scored(spark, sf)
    files.write_scored_batch(d.filter("booking_id % 2 = 0").limit(7), root, "even")
    for k, batch in enumerate(("even", "odd")):
        files.write_scored_batch(d.filter(F.col("booking_id") % 2 == k), root, batch)
    return files.read_scored_batches(spark, root)


@query("scored_sink", W(S.SCORED), as_double=("children",))
def q_scored_sink(spark, sf):
    path = _once(spark, sf, "scored", lambda p: files.write_scored(scored(spark, sf), p))
    return spark.read.parquet(path)


@query("scored_preview", W(f"SELECT * FROM ({S.SCORED}) ORDER BY booking_id LIMIT 200"), as_double=("children",))
def q_scored_preview(spark, sf):
    return files.scored_preview(scored(spark, sf))


_CONTRACT = files.batch_contract_rows(["booking_id", "hotel", "is_canceled", "arrival_date_month", "adults", "country"])


@query("batch_contract", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {p}, {h}, '{a}')" for c, p, h, a in _CONTRACT) + ") AS t(\"column\", present, hard_required, action)")
def q_batch_contract(spark, sf):
    """A03 for a batch that has only some of the columns."""
    b = bookings(spark, sf).select("booking_id", "hotel", "is_canceled", "arrival_date_month", "adults", "country")
    return files.batch_contract(b)


@query("drop_leaky", W("SELECT * EXCLUDE (deposit_type) FROM bookings"), as_double=("children",))
def q_drop_leaky(spark, sf):
    return drop_leaky(bookings(spark, sf))


_TYPED = [f for f in files.BOOKING_SCHEMA.fields if f.dataType.simpleString() != "string"]


@query("dtype_audit", W(" UNION ALL ".join(
    f"SELECT '{f.name}' AS \"column\", '{f.dataType.simpleString()}' AS declared, "
    + {"lead_time": "count(*) FILTER (WHERE booking_id % 7 = 0)", "adults": "count(*) FILTER (WHERE booking_id % 5 = 0)"}.get(f.name, "count(*) FILTER (WHERE false)")
    + " AS n_bad FROM bookings" for f in _TYPED)))
def q_dtype_audit(spark, sf):
    """D25 over a text scan with words and fractions among the whole numbers."""
    b = bookings(spark, sf)
    text = b.select(*[F.col(c).cast("string").alias(c) for c in b.columns])
    text = text.withColumns({"lead_time": F.when(F.col("booking_id").cast("long") % 7 == 0, "soon").otherwise(F.col("lead_time")),
                             "adults": F.when(F.col("booking_id").cast("long") % 5 == 0, "1.5").otherwise(F.concat("adults", F.lit(".0")))})
    return files.dtype_audit(text)


@query("scored_sink_csv", W(f"SELECT booking_id, cancel_probability, prediction, risk_label FROM ({S.SCORED})"))
def q_scored_sink_csv(spark, sf):
    """A04 as CSV, scanned back."""
    path = f"{shared_dir(spark)}/scored-csv-{uuid.uuid4().hex[:12]}"
    files.write_scored(scored(spark, sf), path, fmt="csv")
    d = files.scan_csv(spark, path)
    return d.select("booking_id", F.col("cancel_probability").cast("double").alias("cancel_probability"),
                    F.col("prediction").cast("int").alias("prediction"), "risk_label")


@query("dataset_card", W("SELECT count(*) AS n_rows, 28 AS n_columns, count(DISTINCT hotel) AS n_hotels, "
                         "avg(is_canceled) * 100 AS cancel_rate FROM bookings"))
def q_dataset_card(spark, sf):
    b = bookings(spark, sf)
    return b.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(b.columns)).alias("n_columns"),
                 F.count_distinct("hotel").alias("n_hotels"), (F.avg("is_canceled") * 100).alias("cancel_rate"))


_GRADE_SQL = ("CASE WHEN prediction = 1 AND score >= 0.75 THEN 'very_high' WHEN prediction = 1 THEN 'high' "
              "WHEN score >= 0.40 THEN 'medium' ELSE 'low' END")


@query("batch_score", W(f"SELECT *, {_GRADE_SQL} AS risk_grade FROM ({S.SCORED})"), as_double=("children",))
def q_batch_score(spark, sf):
    """F14 with the bookings' ``score`` in the model's place: probability
    rounded half-even to 4 places, decision on the unrounded value, risk label
    and advice grade.  The model-backed version is ``batch_score_model``."""
    s = scored(spark, sf)
    return s.withColumn("risk_grade", fx.risk_grade("score", "prediction"))


@query("stream_score", W(f"SELECT *, {_GRADE_SQL} AS risk_grade FROM ({S.SCORED})"), as_double=("children",))
def q_stream_score(spark, sf):
    """F14 through Structured Streaming: the written bookings files are read
    as a stream (available-now trigger), scored, and sunk to parquet with a
    checkpoint in the shared folder; the sink is read back."""
    from ..sources.bookings import bookings_path
    from ..streaming.scoring import start_scoring

    def run(path):
        src = bookings_path(spark, sf)
        schema = spark.read.parquet(src).schema
        q = start_scoring(spark, src, schema, path, path + "_checkpoint")
        q.awaitTermination()

    return spark.read.parquet(_once(spark, sf, "stream-scored", run))
