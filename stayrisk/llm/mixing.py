"""Operator 1: mix sources to target weights by pivotal dependent rounding.

Every document has a wanted number of copies r = target / source size of its
source.  floor(r) copies are sure; the fraction p is rounded by a pivotal
tournament inside the source.  A match pairs two documents with fractions
(p, q) and sizes (s, t) and moves words from one to the other, at random and
without changing either expectation, until one of the fractions is 0 or 1.
Words are conserved by every match, so only the last document of a source can
move its total away from the target.  Matches run from long documents to short
ones: an open document closes against others of about its size, and the last
one open is among the shortest.

The tournament is a reduction tree: documents are dealt, by size class and a
hash, into blocks of about ``FANOUT``; each block plays its matches in one
``aggregate`` over a bounded array and hands one residual document to the next
level, whose blocks hold at most ``FANOUT`` children.  A source with a third of
all rows is just a wider tree.  Rows equal in (id, source, size) are interchangeable; they are
pre-aggregated to one item with a multiplicity, so repeats cannot fill a block.

Cases: null text has size 0; null source is a source of its own, ordered last;
a source without words has target 0; documents without words take 0 words;
null and repeated ids are fine; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_array, written

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
FANOUT = 32
REPEAT_RUN = 4096
CLASSES_PER_OCTAVE = 16


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE,
                   cap: float = MAX_REPEAT) -> DataFrame:
    """One row per source: ``source, source_size, n, target``.

    ``sized`` has ``source, size, m`` (m equal rows).  Sources in code point
    order, null last, take the weights in turn and share ``share`` times all
    words; a target stops at ``cap`` times its source and the excess is shared
    again.  The fixed point is a water level: sources fill up in the order of
    cap / weight, and a source is full iff the level that fills it exactly
    needs no more than the total.  Windows here run over sources, not rows.
    """
    by = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", pick).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    by = (by.withColumn("_total", F.lit(share) * F.sum("source_size").over(every))
            .withColumn("_capped", F.sum("_cap").over(upto))
            .withColumn("_rest", F.sum("weight").over(every) - F.sum("weight").over(upto)))
    full = F.col("_capped") + F.col("_cap") / F.col("weight") * F.col("_rest") <= F.col("_total")
    by = by.withColumn("_full", full)
    level = ((F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every))
             / F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0.0)).over(every))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", F.col("weight") * level))
    return by.select("source", "source_size", "n", target.alias("target"))


def _match(state: Column, x: Column, seed: int) -> Column:
    """One match between the open document of ``state`` and the next, ``x``."""
    c, out = state["open"], state["done"]
    give = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])
    take = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), c["item"], x["item"]), 11).cast("double") / F.lit(float(1 << 53)))
    gives = u * (give + take) < take
    # the mover and the change that leaves one of the two fractions integral
    c_ends = F.when(gives, c["p"] * c["size"] <= (1 - x["p"]) * x["size"]).otherwise(
        (1 - c["p"]) * c["size"] <= x["p"] * x["size"])
    x_left = F.when(gives, x["p"] + give / x["size"]).otherwise(x["p"] - take / x["size"])
    c_left = F.when(gives, c["p"] - give / c["size"]).otherwise(c["p"] + take / c["size"])

    def with_p(d: Column, p: Column) -> Column:
        return F.struct(d["item"].alias("item"), d["size"].alias("size"), p.cast("double").alias("p"))

    ended = F.when(c_ends, with_p(c, F.when(gives, 0.0).otherwise(1.0))).otherwise(
        with_p(x, F.when(gives, 1.0).otherwise(0.0)))
    still = F.when(c_ends, with_p(x, x_left)).otherwise(with_p(c, c_left))
    nxt = F.struct(F.concat(out, F.array(ended)).alias("done"), still.alias("open"))
    return F.when(c["item"].isNull(), F.struct(out.alias("done"), x.alias("open"))).otherwise(nxt)


def _play(open_: DataFrame, seed: int) -> DataFrame:
    """Play every block of ``source, block, item, size, p``: rows come back
    with ``done`` (p is 0 or 1) true but for one residual per block."""
    entry = F.struct((-F.col("size")).alias("order"), "item", "size", "p")
    blocks = open_.groupBy("source", "block").agg(F.sort_array(F.collect_list(entry)).alias("items"))
    kind = "struct<done:array<struct<item:bigint,size:bigint,p:double>>,open:struct<item:bigint,size:bigint,p:double>>"
    zero = F.struct(F.array().cast("array<struct<item:bigint,size:bigint,p:double>>").alias("done"),
                    F.lit(None).cast("struct<item:bigint,size:bigint,p:double>").alias("open")).cast(kind)
    end = F.aggregate("items", zero, lambda s, x: _match(s, F.struct(x["item"], x["size"], x["p"]), seed).cast(kind))
    rows = F.concat(F.transform(end["done"], lambda d: F.struct(d.alias("d"), F.lit(True).alias("done"))),
                    F.array(F.struct(end["open"].alias("d"), F.lit(False).alias("done"))))
    return (blocks.select("source", "block", F.explode(rows).alias("r"))
            .select("source", "block", "r.d.item", "r.d.size", "r.d.p", "r.done"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, cap: float = MAX_REPEAT,
        seed: int = 7) -> DataFrame:
    """Copies of every document of ``docs`` (``doc_id, text, source``):
    ``doc_id, source, size, source_size, target, copies, taken``."""
    size = F.size(word_array(F.col("text"))).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size"))
                    .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-sized")
    targets = written(source_targets(sized, weights, share, cap), "mix-targets")
    # a repeated item of m rows wants m * r copies: floor(r) each, then `sure`
    # whole ones among the rows, then one fraction
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(ratio)
    loose = F.col("m") * (ratio - base)
    items = (sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
             .withColumn("base", base).withColumn("sure", F.floor(loose))
             .withColumn("p", F.when(F.col("size") > 0, loose - F.floor(loose)).otherwise(0.0))
             .withColumn("item", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("doc_id").isNull(), F.col("source"))))
    biggest = targets.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(biggest, 2), FANOUT)))
    open_ = (items.filter((F.col("p") > 0) & (F.col("p") < 1))
             .withColumn("class", F.floor(F.log2("size") * CLASSES_PER_OCTAVE))
             .select("source", "class", "item", "size", "p"))
    longer = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = open_.groupBy("source", "class").agg(F.count(F.lit(1)).alias("alike"))
    classes = classes.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "alike",
                             F.coalesce(F.sum("alike").over(longer), F.lit(0)).alias("before"))
    place = F.col("before") + F.pmod(F.xxhash64("item"), F.col("alike"))
    open_ = (open_.join(classes, open_["source"].eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")))
             .select("source", F.floor(place / FANOUT).alias("block"), "item", "size", "p"))
    ended = None
    for level in range(levels + 1):
        if level == levels:  # the roots of all sources; most trees have one already
            open_ = open_.withColumn("block", F.lit(0).cast("long"))
        played = written(_play(open_, seed + level), f"mix-level{level}")
        done = played.filter("done").select("source", "item", "p")
        ended = done if ended is None else ended.unionByName(done)
        open_ = played.filter("not done").select(
            "source", F.floor(F.col("block") / FANOUT).cast("long").alias("block"), "item", "size", "p")
    # what is left of a source is one document: an independent draw
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed - 1), "item"), 11).cast("double") / F.lit(float(1 << 53))
    ended = ended.unionByName(open_.select("source", "item", F.when(u < F.col("p"), 1.0).otherwise(0.0).alias("p")))
    won = ended.filter("p > 0.5").select(F.col("item"), F.lit(1).alias("won"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEAT_RUN)))
    out = (items.join(won, "item", "left")
           .select("doc_id", "source", "size", "source_size", "target", "m", "base",
                   (F.col("sure") + F.coalesce("won", F.lit(0))).alias("extra"), runs.alias("run")))
    row = F.explode(F.sequence(F.col("run") * REPEAT_RUN + 1, F.least("m", (F.col("run") + 1) * REPEAT_RUN)))
    out = out.select("doc_id", "source", "size", "source_size", "target", "base", "extra", row.alias("row"))
    copies = (F.col("base") + F.when(F.col("row") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return (out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", "taken"))
