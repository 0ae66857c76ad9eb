"""Classifier evaluation and cost analysis.

Counting metrics are one aggregate pass.  Ranking metrics (AUC-ROC,
AUC-PR) first collapse rows to distinct scores (map-side partial
aggregation), then take running sums over the scores with
:func:`global_running_sum`, which never puts the ordered table in one task.
Threshold sweeps histogram the rows onto the threshold grid (one pass) and
take suffix sums on the grid table only (never rows x thresholds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import COST_FN, COST_FP, COST_GRID
from ..functions.numeric import safe_div, stable
from .prefix import global_running_sum

Y, P, PRED = "is_canceled", "score", "prediction"

# score blocks for the running sums over distinct scores: 2^20 per unit, so
# the offsets table (one row per block, sorted in one task) stays <= ~1M rows
_SCORE_BLOCK = 1048576.0


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


# G01
def confusion(scored: DataFrame, y: str = Y, pred: str = PRED) -> DataFrame:
    yc, pc = F.col(y), F.col(pred)
    c = scored.agg(_cnt((yc == 0) & (pc == 0)).alias("tn"), _cnt((yc == 0) & (pc == 1)).alias("fp"),
                   _cnt((yc == 1) & (pc == 0)).alias("fn"), _cnt((yc == 1) & (pc == 1)).alias("tp"))
    return with_shares(c)


def with_shares(c: DataFrame) -> DataFrame:
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    c = c.withColumn("total", total)
    return c.withColumns({f"{k}_pct": safe_div(F.col(k), F.col("total")) * 100
                          for k in ("tn", "fp", "fn", "tp")})


def confusion_from_counts(spark: SparkSession, tn: int, fp: int, fn: int, tp: int) -> DataFrame:
    """One-row confusion table from published counts (golden tests)."""
    return with_shares(spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long"))


# G02 (F-scores from counts: (1+b^2)TP / ((1+b^2)TP + b^2 FN + FP))
def class_metrics(conf: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    return conf.select(
        safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_div(1.25 * tp, 1.25 * tp + 0.25 * fn + fp).alias("f05"))


# G03
def fp_tp_ratio(conf: DataFrame) -> DataFrame:
    return conf.select("fp", "tp", safe_div(F.col("fp"), F.col("tp")).alias("fp_tp_ratio"))


def score_counts(scored: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """(score, pos, neg) per distinct score: the only table ranking metrics sort."""
    return (scored.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
            .groupBy(F.col(p).alias("s"))
            .agg(_cnt(F.col(y) == 1).alias("pos"), _cnt(F.col(y) == 0).alias("neg")))


def _below(counts: DataFrame) -> DataFrame:
    """Add pos_below / neg_below: counts with a strictly smaller score."""
    return global_running_sum(counts, order=[F.col("s")],
                              split={"_sblk": F.floor(F.col("s") * _SCORE_BLOCK)},
                              values={"pos_below": F.col("pos"), "neg_below": F.col("neg")},
                              exclusive=True, checkpoint=True)


# G04
def auc_roc(scored: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """Exact ROC AUC with ties counted one half:
    sum over scores of pos * (neg_below + neg/2) / (P * N).
    The numerator is summed as 2*pos*neg_below + pos*neg in DECIMAL(38,0),
    so it is exact and independent of partitioning."""
    b = _below(score_counts(scored, y, p))
    d = "decimal(38,0)"
    term = (F.lit(2).cast(d) * F.col("pos").cast(d) * F.col("neg_below").cast(d)
            + F.col("pos").cast(d) * F.col("neg").cast(d))
    a = b.agg(F.sum(term).alias("num2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select("n_pos", "n_neg",
                    safe_div(F.col("num2").cast("double"),
                             F.lit(2.0) * F.col("n_pos") * F.col("n_neg")).alias("auc_roc"))


# G05
def auc_pr(scored: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """Average precision: sum over distinct scores (high to low) of
    (recall step) x (precision at that score).  Step rule, our choice; MLlib's
    ``areaUnderPR`` uses the trapezoid instead."""
    counts = score_counts(scored, y, p)
    b = _below(counts)
    tot = counts.agg(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar()
    Pt, Nt = tot["P"], tot["N"]
    tp = Pt - F.col("pos_below")
    fp = Nt - F.col("neg_below")
    term = F.when(F.col("pos") > 0, (F.col("pos") / Pt) * (tp / (tp + fp))).otherwise(0.0)
    return b.agg(stable(F.sum(term)).alias("auc_pr"))


# G06
def brier(scored: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    return scored.agg(stable(F.avg((F.col(p) - F.col(y)) ** 2)).alias("brier"))


# G07
def calibration(scored: DataFrame, y: str = Y, p: str = P, bins: int = 10) -> DataFrame:
    """Equal-width bins; gap = |mean p - observed rate|; mean_gap is the plain
    mean over non-empty bins (our choice).  The window runs over <= bins rows."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = (scored.filter(F.col(p).isNotNull()).groupBy(b.alias("bin"))
         .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("observed_rate")))
    g = g.withColumn("g", F.abs(F.col("mp") - F.col("observed_rate")))
    g = g.withColumn("mg", F.avg("g").over(Window.partitionBy(F.lit(0))))
    return g.select("bin", "n", stable("mp").alias("mean_p"), "observed_rate",
                    stable("g").alias("gap"), stable("mg").alias("mean_gap"))


def threshold_index(p: Column, steps: int = 100) -> Column:
    """Largest j with p >= j/steps (exact on the grid values j/steps), clamped
    to [-1, steps]; -1 means below every threshold."""
    k0 = F.floor(p * steps)
    k = (F.when(p < k0 / steps, k0 - 1).when(p >= (k0 + 1) / steps, k0 + 1).otherwise(k0))
    return F.greatest(F.least(k, F.lit(steps)), F.lit(-1)).cast("int")


# G08
def threshold_sweep(scored: DataFrame, y: str = Y, p: str = P, steps: int = 100,
                    cost_fp: float = COST_FP, cost_fn: float = COST_FN) -> DataFrame:
    spark = scored.sparkSession
    h = (scored.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
         .groupBy(threshold_index(F.col(p), steps).alias("j"))
         .agg(_cnt(F.col(y) == 1).alias("pos"), _cnt(F.col(y) == 0).alias("neg")))
    tot = h.agg(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar()
    Pt, Nt = tot["P"], tot["N"]
    grid = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("j"))
    g = grid.join(h, "j", "left").fillna(0, ["pos", "neg"])
    # suffix sums over the (steps+1)-row grid table
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
    g = g.withColumns({"fn": Pt - F.col("tp"), "tn": Nt - F.col("fp")})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select((F.col("j") / steps).alias("threshold"), "tp", "fp", "fn", "tn",
                    safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"),
                    safe_div(1.25 * tp, 1.25 * tp + 0.25 * fn + fp).alias("f05"),
                    (fp * cost_fp + fn * cost_fn).alias("cost"))


# G09
def best_threshold(sweep: DataFrame) -> DataFrame:
    """Least cost; the lowest threshold wins ties (TakeOrdered, one row)."""
    return sweep.orderBy(F.col("cost").asc(), F.col("threshold").asc()).limit(1)


# G10 / G12
def _costs(conf: DataFrame, cfp: Column, cfn: Column) -> DataFrame:
    fp_cost = F.col("fp") * cfp
    fn_cost = F.col("fn") * cfn
    d = conf.withColumns({"fp_cost": fp_cost, "fn_cost": fn_cost})
    d = d.withColumns({"model_cost": F.col("fp_cost") + F.col("fn_cost"),
                       "base_cost": (F.col("fn") + F.col("tp")) * cfn})
    d = d.withColumn("savings", F.col("base_cost") - F.col("model_cost"))
    d = d.withColumn("savings_pct", safe_div(F.col("savings"), F.col("base_cost")) * 100)
    return d.withColumns({
        "dominant_error": F.when(F.col("fp_cost") > F.col("fn_cost"), "False Positive")
                           .otherwise("False Negative"),
        "fp_fn_ratio": F.when(F.col("fn_cost") > 0, F.col("fp_cost") / F.col("fn_cost"))
                        .otherwise(F.lit(0.0))})


def cost_summary(conf: DataFrame, cost_fp: int = COST_FP, cost_fn: int = COST_FN) -> DataFrame:
    out = _costs(conf, F.lit(cost_fp), F.lit(cost_fn))
    return out.select(F.lit(cost_fp).alias("cost_fp"), F.lit(cost_fn).alias("cost_fn"), "fp_cost",
                      "fn_cost", "model_cost", "base_cost", "savings", "savings_pct")


def cost_dominance(conf: DataFrame, cost_fp: int = COST_FP, cost_fn: int = COST_FN) -> DataFrame:
    out = _costs(conf, F.lit(cost_fp), F.lit(cost_fn))
    return out.select("fp_cost", "fn_cost", "dominant_error", "fp_fn_ratio")


# G11
def cost_scenarios(conf: DataFrame, grid: tuple = COST_GRID) -> DataFrame:
    """G10/G12 for every (cost_fp, cost_fn) on the slider grid: two
    generators on the one-row confusion table (39 x 39 rows), no join."""
    lo, hi, step = grid
    d = conf.select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias("cost_fp"))
    d = d.select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias("cost_fn"))
    out = _costs(d, F.col("cost_fp"), F.col("cost_fn"))
    return out.select("cost_fp", "cost_fn", "fp_cost", "fn_cost", "model_cost", "base_cost",
                      "savings", "savings_pct", "dominant_error", "fp_fn_ratio")
