"""Batch scoring on a stream.

Feature building and scoring are per-row projections, so the batch plan runs
unchanged on a ``readStream`` DataFrame: new booking files are scored as
they land, with no state.  The file sink with a checkpoint in the shared
folder gives exactly-once output and restarts after a lost driver or executor.
The running risk mix is the one stateful piece (a streaming aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features as fx


def score_columns(df: DataFrame, p: str = "score") -> DataFrame:
    """Append the batch result columns for probability column ``p``."""
    return (df.withColumns({"cancel_probability": fx.prob_round(p), "prediction": fx.decision(p),
                            "risk_label": fx.risk_label(p)})
            .withColumn("risk_grade", fx.risk_grade(p, "prediction")))


def score_stream(stream: DataFrame, model=None, prob_col: str = "score") -> DataFrame:
    """Score a streaming (or static) bookings DataFrame.

    With a fitted ``PipelineModel`` the 29 features are built and the model's
    probability is used; without one, ``prob_col`` is taken as the probability.
    """
    if model is None:
        return score_columns(stream, prob_col)
    from ..operators.learn import p1
    originals = stream.columns
    d = stream.withColumns({f"_in_{i}": F.col(c) for i, c in enumerate(originals)})
    fm = fx.feature_matrix(d, keep=[f"_in_{i}" for i in range(len(originals))], fill_missing=True)
    out = model.transform(fm)
    prob = [c for c in out.columns if c.startswith("prob_")][-1]
    out = out.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(originals)], p1(prob).alias("_p"))
    return score_columns(out, "_p").drop("_p")


def start_scoring(spark: SparkSession, source: str, schema: T.StructType, sink: str,
                  checkpoint: str, model=None, available_now: bool = True, max_files: int = 64):
    """Start a file-to-file scoring stream; returns the StreamingQuery."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    w = (score_stream(src, model).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def risk_mix_stream(scored_stream: DataFrame) -> DataFrame:
    """Running count per risk label (state: one row per label)."""
    return scored_stream.groupBy("risk_label").agg(F.count(F.lit(1)).alias("n"))
