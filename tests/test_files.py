"""CSV null tokens (S20), type audit, contract report, sinks, model artifact."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrisk.sources import files


def _csv(tmp, text):
    p = os.path.join(tmp, "in.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_null_tokens_and_undefined(spark):
    tmp = tempfile.mkdtemp(prefix="stayrisk-test-")
    p = _csv(tmp, "booking_id,country,lead_time,agent\n1,NULL,5,7\n2,NA,N/A,None\n3,null,,0\n4,Undefined,nan,abc\n5,PRT,12,NaN\n")
    df = files.scan_csv(spark, p).orderBy("booking_id").collect()
    assert [r["country"] for r in df] == [None, None, None, "Undefined", "PRT"]
    assert [r["lead_time"] for r in df] == [5, None, None, None, 12]
    assert [r["agent"] for r in df] == [7.0, None, 0.0, None, None]
    raw = spark.read.option("header", True).csv(p)
    audit = {r["column"]: r["n_bad"] for r in files.dtype_audit(raw).collect()}
    assert audit == {"booking_id": 0, "lead_time": 0, "agent": 1}
    counts = files.file_row_counts(files.scan_csv(spark, p, with_file=True)).collect()
    assert len(counts) == 1 and counts[0]["rows"] == 5


def test_contract_report(spark, sf):
    from stayrisk.sources.bookings import bookings
    b = bookings(spark, sf).drop("meal", "lead_time", "country").withColumn("country_grouped", F.lit("PRT"))
    rep = {r["column"]: r["action"] for r in files.batch_contract(b).collect()}
    assert rep["meal"] == "filled with 0" and rep["lead_time"] == "error"
    assert rep["country"].startswith("ok") and rep["hotel"] == "ok"
    rep = {r["column"]: r["action"] for r in files.batch_contract(b.drop("country_grouped")).collect()}
    assert rep["country"] == "country_grouped filled with 0"


def test_float_text_and_header_order(spark):
    tmp = tempfile.mkdtemp(prefix="stayrisk-test-")
    os.mkdir(os.path.join(tmp, "in"))
    for name, text in (("a.csv", "booking_id,lead_time,adults\n1,10.0,2\n2,2.5,2.0\n"),
                       ("b.csv", "adults,booking_id,lead_time,note\n3,9007199254740993,200,x\n")):
        with open(os.path.join(tmp, "in", name), "w", encoding="utf-8") as f:
            f.write(text)
    df = files.scan_csv(spark, os.path.join(tmp, "in"), with_file=True)
    got = {r["booking_id"]: (r["lead_time"], r["adults"], r["note"]) for r in df.collect()}
    assert got == {1: (10, 2, None), 2: (None, 2, None), 9007199254740993: (200, 3, "x")}
    assert sorted(r["rows"] for r in files.file_row_counts(df).collect()) == [1, 2]
    raw = spark.createDataFrame([("2.5", "7.0"), ("3", None)], "lead_time string, adults string")
    assert {r["column"]: r["n_bad"] for r in files.dtype_audit(raw).collect()} == {"lead_time": 1, "adults": 0}


def test_scored_roundtrip_and_preview(spark, sf):
    from stayrisk.plans.dashboard import scored
    s = scored(spark, sf)
    path = tempfile.mkdtemp(prefix="stayrisk-sink-") + "/out"
    files.write_scored(s, path)
    back = spark.read.parquet(path)
    assert back.count() == s.count()
    assert back.columns[-3:] == files.RESULT_COLUMNS
    assert back.exceptAll(s.select(*back.columns)).count() == 0
    prev = files.scored_preview(s)
    assert prev.columns[:3] == files.RESULT_COLUMNS and prev.count() == 200
    files.write_scored(s, path + "_csv", fmt="csv")
    assert spark.read.option("header", True).csv(path + "_csv").count() == s.count()


def test_model_artifact(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    m = Pipeline(stages=[StringIndexer(inputCol="x", outputCol="i")]).fit(df)
    path = tempfile.mkdtemp(prefix="stayrisk-model-") + "/m"
    files.save_model(m, path, {"threshold": 0.6})
    m2, meta = files.load_model(path)
    assert meta == {"threshold": 0.6}
    assert m2.transform(df).count() == 2
    with pytest.raises(FileNotFoundError):
        files.load_model(path + "_missing")


def test_drop_leaky_keeps_original(spark, sf):
    from stayrisk.operators.quality import drop_leaky
    from stayrisk.sources.bookings import bookings
    b = bookings(spark, sf)
    m = drop_leaky(b)
    assert "deposit_type" not in m.columns and "deposit_type" in b.columns
    assert m.count() == b.count()


def _folder(**texts):
    root = tempfile.mkdtemp(prefix="stayrisk-test-")
    for name, text in texts.items():
        with open(os.path.join(root, f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return root


def test_types_come_from_all_values(spark):
    rows = ["i,d,m,b,t,day,x,none,big,mixed", "1,1.5,2,True,a,2020-02-29,1,,123456789012345678,1", "-7,.5,3.0,false,b,1999-12-31,,NA,5,x",
            "+3,1e-3,,TRUE,1,2020-01-01,2020-01-01,null,12345678901234567890,2.5", "NULL,2.,NaN,NA,True,N/A,3,None,1,True"]
    root = _folder(a="\n".join(rows[:3]) + "\n", b="\n".join([rows[0], *rows[3:]]) + "\n")
    raw = files.scan_text(spark, root)
    got = {r["column"]: (r["type"], r["n_values"]) for r in files.infer_types(raw).collect()}
    assert got == {"i": ("bigint", 3), "d": ("double", 4), "m": ("double", 2), "b": ("boolean", 3), "t": ("string", 4), "day": ("date", 3),
                   "x": ("string", 3), "none": ("string", 0), "big": ("double", 4), "mixed": ("string", 4)}
    df = files.scan_inferred(spark, root)
    assert dict(df.dtypes)["day"] == "date" and sorted(r["i"] or 0 for r in df.collect()) == [-7, 0, 1, 3]
    assert files.infer_types(spark.createDataFrame([], "a string")).collect()[0]["type"] == "string"


def test_one_scan_infers_all_types(spark):
    """The inference is one job over one scan; headers are read from the files'
    first characters, not by a job."""
    root = _folder(a="x,y\n" + "\n".join(f"{i},{i}.5" for i in range(50_000)))
    sc = spark.sparkContext
    sc.setJobGroup("heads", "headers")
    heads = files._by_header(spark, root)
    assert heads == [(["x", "y"], [root])] and sc.statusTracker().getJobIdsForGroup("heads") == []
    raw = files.scan_text(spark, root)
    sc.setJobGroup("kinds", "types")
    kinds = files.infer_types(raw)
    jobs = sc.statusTracker().getJobIdsForGroup("kinds")
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert len(stages) <= 3 and [r["type"] for r in kinds.collect()] == ["bigint", "double"]


def test_headers_with_quotes_line_ends_and_compression(spark):
    import gzip
    root = _folder(a='"id","long\nname","c ""q"""\r\n1,"two\nlines",3\r\n', b='id,c "q"\n5,6\n', empty="", bom="﻿id\n9\n")
    with gzip.open(os.path.join(root, "z.csv.gz"), "wt") as f:
        f.write("id,zip\n7,8\n")
    os.mkdir(os.path.join(root, "_hidden"))
    heads = {tuple(c) for c, _ in files._by_header(spark, root)}
    assert heads == {("id", "long\nname", 'c "q"'), ("id", 'c "q"'), ("id",), ("id", "zip")}
    df = files.scan_inferred(spark, root, multi_line=True)
    got = {r["id"]: r.asDict() for r in df.collect()}
    assert set(got) == {1, 5, 7, 9} and got[1]["long\nname"] == "two\nlines" and got[1]['c "q"'] == 3 and got[7]["zip"] == 8 and got[5]['c "q"'] == 6
    name = "n" * 40_000  # a header longer than one read
    long = _folder(a=f'"{name}\nx",b\n1,2\n')
    assert files._by_header(spark, long)[0][0] == [f"{name}\nx", "b"]
    assert files.scan_text(spark, _folder(empty="")).columns == []


def test_a_batch_may_be_written_again(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="stayrisk-sink-") + "/scored"
    row = lambda ids, label: spark.createDataFrame([(i, 0.5, 1, label) for i in ids], "booking_id long, cancel_probability double, prediction int, risk_label string")
    with pytest.raises(FileNotFoundError):
        files.read_scored_batches(spark, root)
    files.write_scored_batch(row([1, 2], "high"), root, "b1")
    files.write_scored_batch(row([3], "low"), root, "b2")
    before = files.read_scored_batches(spark, root)  # a reader that holds the first run
    files.write_scored_batch(row([1, 5], "low"), root, "b1")
    read = lambda d: sorted((r["batch"], r["booking_id"], r["risk_label"]) for r in d.collect())
    assert read(files.read_scored_batches(spark, root)) == [("b1", 1, "low"), ("b1", 5, "low"), ("b2", 3, "low")]
    assert read(before) == [("b1", 1, "high"), ("b1", 2, "high"), ("b2", 3, "low")]
    # a run that dies before its manifest is not seen
    monkeypatch.setattr(files, "_put_text", lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver")))
    with pytest.raises(RuntimeError):
        files.write_scored_batch(row([9], "high"), root, "b2")
    assert read(files.read_scored_batches(spark, root)) == [("b1", 1, "low"), ("b1", 5, "low"), ("b2", 3, "low")]


def test_whole_numbers_are_typed_without_failing_casts(spark):
    """A text with a point never reaches the cast to a whole number, which would
    raise and catch an exception for each value; the values are what they were."""
    texts = {"2.0": 2, "2.": 2, " 7 ": 7, "+5": 5, "-3.000": -3, "1e3": 1000, "1.5e3": 1500, "2.5": None, "abc": None, "3000000000": None,
             "3000000000.0": None, "Infinity": None, ".0": 0, "1.2.3": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    out = df.select("t", files.typed(F.col("t"), T.IntegerType()).alias("v"))
    assert {r["t"]: r["v"] for r in out.collect()} == texts
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT Contains(lambda" in plan and "cast(t#" not in plan
