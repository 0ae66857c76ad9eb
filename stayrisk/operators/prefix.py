"""Ordered running sums that stay balanced when one segment is huge.

A plain ``Window.partitionBy(seg).orderBy(...)`` puts a whole segment in one
task; one customer (or one label value) holding a third of all rows would
then run on a single core.  Here the segment is cut into blocks by extra
*split* columns that never decrease along the ordering (a date, a hash
prefix, a value bucket).  Running sums are taken inside each block, block
totals (one row per block) get their own running sum per segment, and the
two are added back with an equi-join.  The widest task is one block, and the
offsets table has one row per block rather than per input row.

Blocks are keyed by one struct column: struct equality is null-safe and the
block-local window and the join back share the same hash partitioning, so
the big side is shuffled once.  When the input is expensive to recompute
(joins upstream), ``checkpoint=True`` writes it once as parquet to the
shared checkpoint folder and reads it back, because both the local sums and
the totals read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmented_running_sum(df: DataFrame, segment: list[str], order: list,
                          split: dict[str, Column], values: dict[str, Column],
                          exclusive: bool = True, checkpoint: bool = False) -> DataFrame:
    """Add running sums of ``values`` (name -> column) within ``segment``.

    ``order`` are the sort columns (a total order inside a segment gives a
    deterministic result).  ``split`` (name -> column) must be
    non-decreasing in ``order`` inside a segment.  ``exclusive`` sums rows
    strictly before the current one (SQL ``ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING``, 0 instead of NULL for the first row); otherwise the
    current row is included.  Output: input columns + one column per value.
    """
    vals = {f"_v_{k}": v for k, v in values.items()}
    d = df.withColumns({**split, **vals})
    d = d.withColumns({"_bk": F.struct(*segment, *split), "_sk": F.struct(*segment)})
    if checkpoint:
        # one computation of the input, written to shared storage and read
        # back (DataFrame.checkpoint would compute it twice unless cached)
        import uuid
        from ..session import shared_dir
        spark = d.sparkSession
        path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex[:12]}"
        d.write.mode("overwrite").parquet(path)
        d = spark.read.parquet(path)
    hi = -1 if exclusive else Window.currentRow
    w_local = Window.partitionBy("_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    local = d.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(w_local) for k in values})
    totals = d.groupBy("_bk", "_sk", *split).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    w_off = Window.partitionBy("_sk").orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_bk", *[F.sum(f"_t_{k}").over(w_off).alias(f"_o_{k}") for k in values])
    out = local.join(offs, "_bk", "inner").withColumns({
        k: F.coalesce(F.col(f"_l_{k}"), F.lit(0)) + F.coalesce(F.col(f"_o_{k}"), F.lit(0))
        for k in values})
    drop = ["_bk", "_sk", *split, *vals] + [f"_l_{k}" for k in values] + [f"_o_{k}" for k in values]
    return out.drop(*drop)


def global_running_sum(df: DataFrame, order: list, split: dict[str, Column],
                       values: dict[str, Column], exclusive: bool = True,
                       checkpoint: bool = False) -> DataFrame:
    """Running sums over the whole table in ``order`` (no segment)."""
    seg = "_seg_all"
    out = segmented_running_sum(df.withColumn(seg, F.lit(0)), [seg], order, split, values,
                                exclusive, checkpoint)
    return out.drop(seg)


def nested_running_sum(df: DataFrame, segment: list[str], order: list, levels: dict[str, Column],
                       values: dict[str, Column]) -> DataFrame:
    """Exclusive running sums of ``values`` within ``segment`` for segments of
    any size.

    ``levels`` (name -> column), read in turn, must never decrease along
    ``order`` (a day, a minute of that day, ...).  They form a tree of blocks:
    a block's offset is its parent's plus the totals of its earlier siblings,
    so no window holds more than one block's children or one leaf's rows.
    """
    names = list(levels)
    d = df.withColumns({**levels, **{f"_v_{k}": v for k, v in values.items()}})
    path = lambda k: F.struct(*segment, *names[:k])  # noqa: E731 - struct equality is null-safe
    before = Window.unboundedPreceding, -1
    tables = {len(names): d.groupBy(*segment, *names).agg(*[F.sum(f"_v_{v}").alias(f"_t_{v}") for v in values])}
    for k in range(len(names) - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(*segment, *names[:k]).agg(*[F.sum(f"_t_{v}").alias(f"_t_{v}") for v in values])
    offsets = None
    for k in range(1, len(names) + 1):
        w = Window.partitionBy(path(k - 1)).orderBy(names[k - 1]).rowsBetween(*before)
        t = tables[k].select(path(k).alias("_path"), path(k - 1).alias("_up"),
                             *[F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}") for v in values])
        if offsets is not None:
            up = offsets.select(F.col("_path").alias("_up"), *[F.col(f"_o_{v}").alias(f"_p_{v}") for v in values])
            t = t.join(up, "_up").select("_path", *[(F.col(f"_o_{v}") + F.col(f"_p_{v}")).alias(f"_o_{v}") for v in values])
        offsets = t.drop("_up")
    leaf = path(len(names))
    w = Window.partitionBy(leaf).orderBy(*order).rowsBetween(*before)
    local = d.withColumns({f"_l_{v}": F.coalesce(F.sum(f"_v_{v}").over(w), F.lit(0)) for v in values}).withColumn("_path", leaf)
    out = local.join(offsets, "_path").withColumns({v: F.col(f"_l_{v}") + F.col(f"_o_{v}") for v in values})
    return out.select(*df.columns, *values)
