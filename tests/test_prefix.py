"""Balanced running sums equal plain window running sums, with a hot segment."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stayrisk.operators.prefix import global_running_sum, segmented_running_sum


def _data(spark, n=3000):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        seg = 0 if i % 3 == 0 else rnd.randint(1, 40)   # one segment holds a third
        if i % 97 == 0:
            seg = None
        rows.append((i, seg, rnd.randint(0, 50), rnd.randint(-3, 5)))
    return spark.createDataFrame(rows, "id long, seg int, t int, v int")


def test_segmented_matches_window(spark):
    df = _data(spark)
    for exclusive in (True, False):
        got = segmented_running_sum(df, ["seg"], [F.col("t"), F.col("id")],
                                    {"_b": F.floor(F.col("t") / 5)}, {"rs": F.col("v")}, exclusive)
        hi = -1 if exclusive else 0
        w = Window.partitionBy("seg").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, hi)
        ref = df.withColumn("rs_ref", F.coalesce(F.sum("v").over(w), F.lit(0)))
        j = got.join(ref, "id")
        assert got.count() == df.count()
        assert j.filter(F.col("rs") != F.col("rs_ref")).count() == 0


def test_global_running_sum(spark):
    df = _data(spark).select("id", "t", "v")
    got = global_running_sum(df, [F.col("t"), F.col("id")], {"_b": F.col("t")}, {"rs": F.col("v")}, False)
    w = Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("rs_ref", F.sum("v").over(w))
    assert got.join(ref, "id").filter(F.col("rs") != F.col("rs_ref")).count() == 0
