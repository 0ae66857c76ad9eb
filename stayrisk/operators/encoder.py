"""The model's feature encoder as one persistable ML stage.

What is learned is one row per category value and four quartile triples, from one
aggregate by (fold, part, column, value) and one exact multi-pass selection.
Statistics are kept by fold, so the encoders of all training sets that are unions
of folds come from the same aggregate (:func:`fit_subsets`).  Transforming is a
projection; target codes come by a join with the learned values.  These are model
state that the driver holds already, so they are broadcast: dealt by value, all
rows of a frequent country or agent would meet in one task.

F05 here is :func:`stayrisk.operators.encode.robust_scaled`, the query's own
expression and quartiles.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encode as en
from .quantiles import quantiles

LABEL = "is_canceled"
ONEHOT_COLS = ["hotel", "meal", "distribution_channel", "reserved_room_type", "customer_type",
               "arrival_season", "babies_bin", "children_bin", "parking_bin", "prev_cancel_bin",
               "prev_loyal_bin", "booking_changes_bin"]
TARGET_COLS = {"agent": "agent_te_num", "country_grouped": "country_te_num"}
BINARY_COLS = ["market_segment"]
LOG_COLS = ["lead_time", "adr", "days_in_waiting_list", "lead_x_transient"]
PLAIN_COLS = ["stays_in_weekend_nights", "stays_in_week_nights", "adults", "is_repeated_guest",
              "total_of_special_requests", "month_sin", "month_cos", "no_commitment",
              "is_weekend_only", "has_company"]
PARTS = 5


def code_width(levels: int) -> int:
    """Bits for codes 1..levels; 0 is the code of null and unseen values."""
    return max(1, levels.bit_length())


def _log(c: str):
    return F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))


def _level(c: str, known: Sequence[str], other: int) -> Column:
    """A value's place among the known ones; ``other`` for null and unseen values."""
    at = F.array_position(F.array(*[F.lit(v) for v in known]).cast("array<string>"), F.col(c).cast("string")).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.lit(other))


def part_of():
    """Part of a training row, for target codes from the other parts."""
    return F.pmod(en.portable_hash(), F.lit(PARTS)).cast("int")


def category_stats(df: DataFrame, fold: str) -> list:
    """Rows ``fold, part, column, value, s, n`` (label sum and count): one
    aggregate for all category columns, one row per value and part."""
    cols = [*ONEHOT_COLS, *TARGET_COLS, *BINARY_COLS]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.col(fold).alias("fold"), part_of().alias("part"), F.col(LABEL).alias("y"), F.inline(entries))
            .groupBy("fold", "part", "column", "value").agg(F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("s"), F.count("y").alias("n"),
                                                            F.count(F.lit(1)).alias("rows")).collect())


def target_codes(stats: list, m: float) -> dict:
    """m-estimates of one column from ``(part, value, s, n)``: ``prior`` by part
    (-1: all rows) and ``codes``, rows (value, part, code); the code of a part
    comes from the other parts."""
    total: dict = {}
    own: dict = {}
    for part, value, s, n in stats:
        for key in ((-1, None), (part, None)) + (((-1, value), (part, value)) if value is not None else ()):
            a, b = own.get(key, (0, 0))
            own[key] = (a + s, b + n)
    all_s, all_n = own.get((-1, None), (0, 0))
    rest = lambda t, part, value: (t[0] - own.get((part, value), (0, 0))[0], t[1] - own.get((part, value), (0, 0))[1]) if part >= 0 else t
    prior = {}
    for part in (-1, *range(PARTS)):
        s, n = rest((all_s, all_n), part, None)
        prior[part] = s / n if n else (all_s / all_n if all_n else 0.0)
    for (part, value), t in own.items():
        if part == -1 and value is not None:
            total[value] = t
    codes = []
    for value in sorted(total):
        for part in (-1, *range(PARTS)):
            s, n = rest(total[value], part, value)
            codes.append((value, part, (s + m * prior[part]) / (n + m)))
    return {"prior": {str(k): v for k, v in prior.items()}, "codes": codes}


def fit_subsets(df: DataFrame, fold: str, subsets: dict[int, Sequence[int]], smoothing: float = 10.0) -> dict[int, "FeatureEncoderModel"]:
    """One encoder per subset (number -> the folds that it is fitted on), all from
    one aggregate and one selection.  Levels are those of all folds, so that the
    encoders have the same slots; codes and quartiles are the subset's own."""
    stats = category_stats(df, fold)
    levels = {c: sorted({r["value"] for r in stats if r["column"] == c and r["value"] is not None}) for c in (*ONEHOT_COLS, *BINARY_COLS)}
    member = F.array(*[F.when(F.col(fold).isin(list(folds)), F.lit(s)) for s, folds in subsets.items()])
    rows = df.select(F.explode(F.array_compact(member)).alias("_subset"), *[_log(c).alias(c) for c in LOG_COLS])
    q = {(r["_subset"], r["column"]): r["q"] for r in quantiles(rows, {c: F.col(c) for c in LOG_COLS}, [0.25, 0.5, 0.75], ["_subset"]).collect()}
    out = {}
    for s, folds in subsets.items():
        mine = [r for r in stats if r["fold"] in set(folds)]
        learned = {"levels": levels, "quartiles": {c: q.get((s, c)) for c in LOG_COLS}, "smoothing": smoothing,
                   "target": {c: target_codes([(r["part"], r["value"], r["s"], r["n"]) for r in mine if r["column"] == c], smoothing) for c in TARGET_COLS}}
        out[s] = FeatureEncoderModel()._set(learned=json.dumps(learned))
    return out


class FeatureEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot (no level dropped, one slot for null and unseen values), base-2
    codes, smoothed target codes and log1p + exact robust scaling."""

    smoothing = Param(Params._dummy(), "smoothing", "rows the prior counts for", typeConverter=TypeConverters.toFloat)

    def __init__(self, smoothing: float = 10.0):
        super().__init__()
        self._set(smoothing=smoothing)

    def _fit(self, df: DataFrame) -> "FeatureEncoderModel":
        return fit_subsets(df.withColumn("_fold", F.lit(1)), "_fold", {0: [1]}, self.getOrDefault(self.smoothing))[0]


class FeatureEncoderModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``agent_te_num, country_te_num, market_segment_<i>`` and the vector
    ``features`` (missing numbers: NaN) with slot names."""

    learned = Param(Params._dummy(), "learned", "levels, codes and quartiles as JSON", typeConverter=TypeConverters.toString)

    def _slots(self) -> tuple[dict, list[str], Column]:
        """(what was learned, slot names, array of the slots).  A one-hot column's
        slots are one expression, a slice of zeros around a 1, and missing numbers
        become NaN in a lambda.  Spark fuses no lambda into a stage's one method,
        which with all slots in it is too long for the JVM to compile."""
        state = json.loads(self.getOrDefault(self.learned))
        names, slots, hot = [], [], []
        for c in ONEHOT_COLS:
            known = state["levels"][c]
            names += [*[f"{c}_ohe_{v}" for v in known], f"{c}_ohe___unknown"]
            zeros = [0.0] * len(known)
            hot.append(F.slice(F.lit([*zeros, 1.0, *zeros]), len(known) + 1 - _level(c, known, len(known)), len(known) + 1))
        for out in TARGET_COLS.values():
            names.append(out)
            slots.append(F.col(out))
        for i in range(code_width(len(state["levels"]["market_segment"]))):
            names.append(f"market_segment_{i}")
            slots.append(F.col(f"market_segment_{i}"))
        for c in LOG_COLS:
            names.append(f"log_scaled_{c}")
            quartiles = state["quartiles"][c]
            scaled = en.robust_scaled(_log(c), quartiles) if quartiles else F.lit(None).cast("double")
            slots.append(F.coalesce(scaled, F.when(F.col(c).isNotNull(), 0.0)))  # no spread: 0
        for c in PLAIN_COLS:
            names.append(c)
            slots.append((F.col("company").isNotNull() if c == "has_company" else F.col(c)).cast("double"))
        return state, names, F.concat(*hot, F.transform(F.array(*slots), lambda v: F.coalesce(v, F.lit(float("nan")))))

    def binary_slots(self) -> list[int]:
        """Slots that hold only 0 and 1."""
        _, names, _ = self._slots()
        return [i for i, n in enumerate(names) if "_ohe_" in n or n.startswith("market_segment_")]

    def one_hot_slots(self) -> list[list[int]]:
        """Slots of each one-hot column; every row has one of them."""
        levels, out, at = json.loads(self.getOrDefault(self.learned))["levels"], [], 0
        for c in ONEHOT_COLS:
            out.append(list(range(at, at + len(levels[c]) + 1)))
            at += len(levels[c]) + 1
        return out

    def slots(self) -> list[str]:
        return self._slots()[1]

    def _coded(self, df: DataFrame, state: dict, part) -> DataFrame:
        """Target codes by a join on the learned values; null and unseen values
        get the prior."""
        d = df.withColumn("_part", part)
        for c, out in TARGET_COLS.items():
            t = state["target"][c]
            if t["codes"]:
                table = df.sparkSession.createDataFrame([tuple(x) for x in t["codes"]], f"_v{out} string, _p{out} int, _{out} double")
                d = d.join(F.broadcast(table), (F.col(c).cast("string") == F.col(f"_v{out}")) & (F.col("_part") == F.col(f"_p{out}")), "left")
            else:
                d = d.withColumn(f"_{out}", F.lit(None).cast("double"))
            prior = F.lit(t["prior"]["-1"])
            for p in range(PARTS):
                prior = F.when(F.col("_part") == p, F.lit(t["prior"][str(p)])).otherwise(prior)
            d = d.withColumn(out, F.coalesce(F.col(f"_{out}"), prior)).drop(f"_v{out}", f"_p{out}", f"_{out}")
        return d.drop("_part")

    def _encoded(self, df: DataFrame, part) -> DataFrame:
        state, names, slots = self._slots()
        d = self._coded(df, state, part)
        known = state["levels"]["market_segment"]
        width = code_width(len(known))
        code = _level("market_segment", known, -1) + 1
        d = d.withColumns({f"market_segment_{i}": F.shiftright(code, width - 1 - i).bitwiseAND(1).cast("double") for i in range(width)})
        meta = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}}
        return d.withColumn("features", array_to_vector(slots).alias("features", metadata=meta))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._encoded(df, F.lit(-1))

    def transform_train(self, df: DataFrame) -> DataFrame:
        """Features of the rows the encoder was fitted on: target codes come from
        the other parts, so a row's own label is not in its features."""
        return self._encoded(df, part_of())
