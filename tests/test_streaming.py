"""The scoring plan on a stream equals the batch plan."""

import tempfile

from stayrisk.plans.dashboard import scored
from stayrisk.sources.bookings import bookings_path
from stayrisk.streaming.scoring import risk_mix_stream, score_stream, start_scoring


def test_stream_equals_batch(spark, sf):
    src = bookings_path(spark, sf)
    schema = spark.read.parquet(src).schema
    out = tempfile.mkdtemp(prefix="stayrisk-stream-")
    q = start_scoring(spark, src, schema, out + "/sink", out + "/ckpt")
    q.awaitTermination()
    got = spark.read.parquet(out + "/sink")
    batch = score_stream(spark.read.parquet(src))
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
    # a restart from the same checkpoint adds nothing (exactly once)
    q2 = start_scoring(spark, src, schema, out + "/sink", out + "/ckpt")
    q2.awaitTermination()
    assert spark.read.parquet(out + "/sink").count() == batch.count()


def test_risk_mix_stream(spark, sf):
    src = bookings_path(spark, sf)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = (risk_mix_stream(score_stream(stream)).writeStream.outputMode("complete")
         .format("memory").queryName("risk_mix_t").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["risk_label"]: r["n"] for r in spark.sql("SELECT * FROM risk_mix_t").collect()}
    ref = {r["risk_label"]: r["count"] for r in scored(spark, sf).groupBy("risk_label").count().collect()}
    assert got == ref


def test_stream_with_a_model_equals_batch(spark, sf):
    from stayrisk.operators import learn as ln
    from stayrisk.sources.bookings import bookings
    model = ln.fit_pipeline(ln.model_frame(bookings(spark, sf)), "gbt_shallow", maxIter=3)
    src = bookings_path(spark, sf)
    schema = spark.read.parquet(src).schema
    out = tempfile.mkdtemp(prefix="stayrisk-stream-")
    start_scoring(spark, src, schema, out + "/sink", out + "/ckpt", model=model).awaitTermination()
    got = spark.read.parquet(out + "/sink")
    assert got.columns == [*schema.names, "cancel_probability", "prediction", "risk_label", "risk_grade"]
    batch = score_stream(spark.read.parquet(src).drop("is_canceled"), model)
    assert got.drop("is_canceled").exceptAll(batch.select(*[c for c in got.columns if c != "is_canceled"])).count() == 0
