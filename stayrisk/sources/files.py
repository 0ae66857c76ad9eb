"""File sources and sinks for booking batches.

CSV is read with every column as text, pandas' null tokens are mapped to
null, and values are converted with ``try_cast`` (Spark 4 runs in ANSI mode,
where a plain cast of bad text raises).  All of it is column expressions
over the scan: no Python per row.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CONTRACT_COLUMNS, CSV_NULL_TOKENS, HARD_REQUIRED
from ..functions.features import FILL_WITH_ZERO

BOOKING_SCHEMA = T.StructType([
    T.StructField("booking_id", T.LongType()), T.StructField("hotel", T.StringType()),
    T.StructField("is_canceled", T.IntegerType()), T.StructField("lead_time", T.IntegerType()),
    T.StructField("arrival_date_month", T.StringType()),
    T.StructField("stays_in_weekend_nights", T.IntegerType()),
    T.StructField("stays_in_week_nights", T.IntegerType()), T.StructField("adults", T.IntegerType()),
    T.StructField("children", T.IntegerType()), T.StructField("babies", T.IntegerType()),
    T.StructField("meal", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("market_segment", T.StringType()), T.StructField("distribution_channel", T.StringType()),
    T.StructField("is_repeated_guest", T.IntegerType()),
    T.StructField("previous_cancellations", T.IntegerType()),
    T.StructField("previous_bookings_not_canceled", T.IntegerType()),
    T.StructField("reserved_room_type", T.StringType()), T.StructField("booking_changes", T.IntegerType()),
    T.StructField("deposit_type", T.StringType()), T.StructField("agent", T.DoubleType()),
    T.StructField("company", T.DoubleType()), T.StructField("days_in_waiting_list", T.IntegerType()),
    T.StructField("customer_type", T.StringType()), T.StructField("adr", T.DoubleType()),
    T.StructField("required_car_parking_spaces", T.IntegerType()),
    T.StructField("total_of_special_requests", T.IntegerType()), T.StructField("score", T.DoubleType()),
])


def null_tokens_to_null(c: str, tokens: Sequence[str] = CSV_NULL_TOKENS):
    return F.when(F.col(c).isin(list(tokens)), F.lit(None)).otherwise(F.col(c))


def typed(v, data_type: T.DataType):
    """Text as ``data_type``; null if it is not one.  Whole numbers may carry a
    fraction of zeros (``2.0``), as tables with missing values export them."""
    if not isinstance(data_type, (T.IntegerType, T.LongType, T.ShortType)):
        return v.try_cast(data_type)

    def one(t):
        number = t.try_cast("double")
        whole = F.when(number == F.floor(number), number.cast("decimal(38,0)").try_cast(data_type))
        # text with a point is no whole number to try_cast, which finds out by an exception
        plain = F.when(~t.contains("."), t.try_cast(data_type))
        return F.coalesce(plain, F.when(F.abs(number) < F.lit(1e18), whole))

    # in a lambda the text is found once, and Spark does not fuse all columns into a
    # stage's one method, which would be too long for the JVM to compile
    return F.transform(F.array(v), one)[0]


HEAD_CHARS = 1 << 14


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The data files that Spark would read at a path, folder or glob."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, out = list(fs.globStatus(p) or []), []
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += list(fs.listStatus(s.getPath()))
        elif s.getLen() > 0:
            out.append(s.getPath().toString())
    hidden = lambda f: f.rsplit("/", 1)[-1].startswith(("_", "."))
    return sorted(f for f in out if not hidden(f))


def first_record(spark: SparkSession, file: str) -> list[str]:
    """The header of a CSV file from its first characters alone; more are read
    only while a quoted name runs on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    size = HEAD_CHARS
    while True:
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
            plain = codec.createInputStream(stream) if codec is not None else stream
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"), min(size, HEAD_CHARS))
            lines, chars = [], 0
            while chars < size:
                line = reader.readLine()
                if line is None:
                    break
                lines.append(line)
                chars += len(line) + 1
                if "\n".join(lines).count('"') % 2 == 0:  # no quoted field is open
                    break
            else:
                size *= 2
                continue
        finally:
            stream.close()
        return next(csv.reader(io.StringIO("\n".join(lines).lstrip("\ufeff"), newline="")), [])


def _by_header(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(columns, paths) for each distinct header among the CSV files of ``path``:
    files are matched by name, not by position.  Headers come from the files'
    first bytes, some files at a time; files of one header are read by ``path``
    itself."""
    from concurrent.futures import ThreadPoolExecutor
    names = csv_files(spark, path)
    with ThreadPoolExecutor(max_workers=16) as pool:
        heads = list(pool.map(lambda f: tuple(first_record(spark, f)), names))
    by: dict[tuple, list[str]] = {}
    for head, name in zip(heads, names):
        by.setdefault(head, []).append(name)
    if len(by) == 1:
        return [(list(head), [path]) for head in by]
    return [(list(head), files) for head, files in by.items()]


def _raw_csv(spark: SparkSession, path: str, with_file: bool, multi_line: bool) -> DataFrame | None:
    """All files of ``path`` with every column as text, matched by name."""
    raw = None
    for columns, names in _by_header(spark, path):
        text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        part = spark.read.schema(text).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(names)
        if with_file:
            part = part.withColumn("source_file", F.input_file_name())
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    return raw


# A01 / A02
def scan_csv(spark: SparkSession, path: str, schema: T.StructType = BOOKING_SCHEMA,
             tokens: Sequence[str] = CSV_NULL_TOKENS, with_file: bool = False, multi_line: bool = False) -> DataFrame:
    """Read booking CSV file(s) (a path, folder or glob) with a header.

    Columns in ``schema`` are converted to their declared type; any other
    columns stay text.  Files may have their columns in any order; a column
    that a file lacks is null there.  ``with_file`` adds the source file name
    (A02's per-file row counts are a ``groupBy`` on it).  ``multi_line`` reads
    quoted fields with line ends in them; a file is then one task's work.
    """
    raw = _raw_csv(spark, path, with_file, multi_line)
    if raw is None:  # no file has a line
        raw = spark.createDataFrame([], T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
    types = {f.name: f.dataType for f in schema.fields}
    cols = []
    for c in raw.columns:
        v = null_tokens_to_null(c, tokens) if c != "source_file" else F.col(c)
        if c in types and not isinstance(types[c], T.StringType):
            v = typed(v, types[c])
        cols.append(v.alias(c))
    return raw.select(*cols)


#: Kinds of values as bits: a column's kinds are the OR of its values' bits.
INT, DOUBLE, BOOL, DATE, TEXT = 1, 2, 4, 8, 16
INT_PATTERN = r"^[+-]?[0-9]{1,18}$"
DOUBLE_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def value_kind(v) -> Column:
    """The bit of a text value's narrowest type; 0 for null."""
    return (F.when(v.isNull(), 0).when(v.rlike(INT_PATTERN), INT).when(v.rlike(DOUBLE_PATTERN), DOUBLE)
            .when(v.isin("True", "False", "TRUE", "FALSE", "true", "false"), BOOL)
            .when(v.rlike(DATE_PATTERN) & v.try_cast("date").isNotNull(), DATE).otherwise(TEXT))


def type_of_kinds(kinds: int) -> str:
    """The least type that holds all kinds: null < int < double < text, bool <
    text, date < text.  A column without values is text."""
    return {INT: "bigint", DOUBLE: "double", INT | DOUBLE: "double", BOOL: "boolean", DATE: "date"}.get(kinds, "string")


def infer_types(raw: DataFrame, tokens: Sequence[str] = CSV_NULL_TOKENS) -> DataFrame:
    """``column, type, n_values`` of a table of text columns, over all values in
    one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(raw.columns):
        v = null_tokens_to_null(c, tokens)
        aggs += [F.bit_or(value_kind(v)).alias(f"k{i}"), F.count(v).alias(f"n{i}")]
    r = raw.agg(*aggs).first()
    rows = [(c, type_of_kinds(r[f"k{i}"] or 0), r[f"n{i}"]) for i, c in enumerate(raw.columns)]
    return raw.sparkSession.createDataFrame(rows, "`column` string, type string, n_values long")


def scan_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Any CSV with a header, every column as text."""
    raw = _raw_csv(spark, path, False, multi_line)
    return spark.createDataFrame([], T.StructType([])) if raw is None else raw


def scan_inferred(spark: SparkSession, path: str, tokens: Sequence[str] = CSV_NULL_TOKENS, multi_line: bool = False) -> DataFrame:
    """Read any CSV with a header; types are inferred from all values."""
    raw = scan_text(spark, path, multi_line)
    kinds = {r["column"]: r["type"] for r in infer_types(raw, tokens).collect()}
    return raw.select(*[null_tokens_to_null(c, tokens).cast(kinds[c]).alias(c) for c in raw.columns])


def scan_bookings(spark: SparkSession, path: str, fmt: str = "csv", **kw) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    return scan_csv(spark, path, **kw)


def file_row_counts(df: DataFrame) -> DataFrame:
    """Rows per source file of a ``scan_csv(..., with_file=True)`` scan."""
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


# D25
def dtype_audit(raw_text: DataFrame, schema: T.StructType = BOOKING_SCHEMA,
                tokens: Sequence[str] = CSV_NULL_TOKENS) -> DataFrame:
    """Per declared non-text column: values present but not parseable as the
    declared type (for whole numbers also values with a fraction).  One
    aggregate pass over the text scan."""
    fields = [f for f in schema.fields if f.name in raw_text.columns
              and not isinstance(f.dataType, T.StringType)]
    aggs = []
    for f in fields:
        v = null_tokens_to_null(f.name, tokens)
        aggs.append(F.count_if(v.isNotNull() & typed(v, f.dataType).isNull()).alias(f.name))
    row = raw_text.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("declared"),
                             F.col(f.name).alias("n_bad")) for f in fields])
    return row.select(F.inline(arr))


def write_with_null_tokens(df: DataFrame, path: str, tokens: Sequence[str] = ("NULL", "NA", "N/A", "None", "null", "", "nan"),
                           key: str = "booking_id") -> None:
    """Write CSV files that exercise the scan: each null is spelled with a
    different token (picked by key), a part of the whole numbers is written as
    ``2.0``, and half of the rows go to files with the columns reversed."""
    k = len(tokens)
    tok = F.element_at(F.array(*[F.lit(t) for t in tokens]), (F.col(key) % k + 1).cast("int"))
    cols = []
    for f in df.schema.fields:
        v = F.col(f.name).cast("string")
        if isinstance(f.dataType, T.IntegerType):
            v = F.when(F.col(key) % 3 == 0, F.concat(v, F.lit(".0"))).otherwise(v)
        cols.append(F.coalesce(v, tok).alias(f.name))
    for part, order in ((0, cols), (1, cols[::-1])):
        (df.filter(F.pmod(F.xxhash64(key), F.lit(2)) == part).select(*order).write.mode("append")
         .option("header", True).option("emptyValue", "").option("escape", '"').csv(path))


# A03
def batch_contract_rows(columns: Sequence[str]) -> list[tuple[str, bool, bool, str]]:
    have, rows = set(columns), []
    for c in CONTRACT_COLUMNS:
        if c in have:
            action = "ok"
        elif c == "country":
            action = "ok (country_grouped given)" if "country_grouped" in have else "country_grouped filled with 0"
        elif c in HARD_REQUIRED:
            action = "error"
        elif c in FILL_WITH_ZERO:
            action = "filled with 0"
        else:
            action = "ignored"
        rows.append((c, c in have, c in HARD_REQUIRED, action))
    return rows


def batch_contract(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Contract report: for each contract column, present / hard-required /
    what happens when missing (error, filled with 0, or ignored)."""
    return (spark or df.sparkSession).createDataFrame(
        batch_contract_rows(df.columns), "column string, present boolean, hard_required boolean, action string")


# A04 / A05
RESULT_COLUMNS = ["cancel_probability", "prediction", "risk_label"]


def write_scored(scored: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Originals first, then the three result columns.  Parquet is
    partitioned by ``risk_label`` (reports by label prune partitions); CSV
    is written with a header and no index, UTF-8."""
    originals = [c for c in scored.columns if c not in RESULT_COLUMNS]
    out = scored.select(*originals, *RESULT_COLUMNS)
    w = out.write.mode("overwrite")
    if fmt == "parquet":
        w.partitionBy("risk_label").parquet(path)
    else:
        w.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def write_scored_batch(scored: DataFrame, root: str, batch: str) -> None:
    """Write one scored batch under ``root`` so that it may be written again.

    Rows go to a folder of this run (``data/batch=<batch>/run=<run>``, parquet by
    ``risk_label``); the batch's manifest, written last and put in place by one
    rename, names the run that counts.  Scoring a batch again replaces only it; a
    reader sees the old rows or the new ones, and nothing of a run that failed."""
    spark, run = scored.sparkSession, uuid.uuid4().hex[:16]
    originals = [c for c in scored.columns if c not in RESULT_COLUMNS]
    scored.select(*originals, *RESULT_COLUMNS).write.partitionBy("risk_label").parquet(f"{root}/data/batch={batch}/run={run}")
    _put_text(spark, f"{root}/manifest/{batch}", json.dumps({"batch": batch, "run": run}))


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all, in place of an older one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    fresh = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex[:8]}")
    stream = fs.create(fresh)
    stream.write(bytearray(text.encode()))
    stream.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    uri = fs.makeQualified(target).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf).rename(fs.makeQualified(fresh), fs.makeQualified(target), how)


def scored_runs(spark: SparkSession, root: str) -> dict[str, str]:
    """Batch -> the run that counts, from the manifests."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    rows = [json.loads(r["value"]) for r in spark.read.text(f"{root}/manifest").collect()]
    return {r["batch"]: r["run"] for r in rows}


def read_scored_batches(spark: SparkSession, root: str) -> DataFrame:
    """All batches' rows, with ``batch``, of the runs that count."""
    runs = scored_runs(spark, root)
    if not runs:
        raise FileNotFoundError(f"no scored batch at {root}")
    paths = [f"{root}/data/batch={b}/run={r}" for b, r in sorted(runs.items())]
    return spark.read.option("basePath", f"{root}/data").parquet(*paths).drop("run").withColumn("batch", F.col("batch").cast("string"))


def scored_preview(scored: DataFrame, n: int = 200, key: str = "booking_id") -> DataFrame:
    """First n rows by key, result columns first (TakeOrderedAndProject)."""
    originals = [c for c in scored.columns if c not in RESULT_COLUMNS]
    return scored.select(*RESULT_COLUMNS, *originals).orderBy(key).limit(n)


# A06
def save_model(model, path: str, meta: dict) -> None:
    """MLlib ``PipelineModel.save`` plus a JSON sidecar (threshold, feature
    columns, metrics) written next to it through Spark."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(path.rstrip("/") + "_meta")


def load_model(path: str):
    """(PipelineModel, meta dict); a clear error when nothing is there."""
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    try:
        model = PipelineModel.load(path)
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"no model at {path}: {e}") from e
    rows = spark.read.text(path.rstrip("/") + "_meta").collect()
    return model, (json.loads(rows[0][0]) if rows else {})
