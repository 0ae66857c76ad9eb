"""Model training, cross-validation and tuning on MLlib.

Every fit is a distributed MLlib job on DataFrames; independent fits are
overlapped from a small driver thread pool.  Intermediate results that are
read more than once are written to the shared folder.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import THRESHOLD
from ..functions import features as fx
from ..functions.numeric import safe_div, stable
from . import boost
from . import encode as en
from . import evaluate as ev
from .boost import LEARNERS
from .encoder import LABEL, FeatureEncoder, fit_subsets

# ---------------------------------------------------------------- model frame
def model_frame(bookings: DataFrame, weighted: bool = True) -> DataFrame:
    """Key + label (+ balanced weight) + the 29 features.  ``deposit_type`` is
    not among them (leaky, B09)."""
    fm = fx.feature_matrix(bookings, keep=("booking_id", LABEL))
    return en.with_class_weight(fm, LABEL) if weighted else fm.withColumn("weight", F.lit(1.0))


def fit_featurizer(train: DataFrame, te_smoothing: float = 10.0) -> PipelineModel:
    """F02-F05 as one persistable stage (:mod:`.encoder`)."""
    return PipelineModel(stages=[FeatureEncoder(te_smoothing).fit(train)])


def train_matrix(featurizer: PipelineModel, train: DataFrame) -> DataFrame:
    """Features of the rows the featurizer was fitted on: as it transforms
    them, but each row's target encodings come from the other parts, so a row's
    own label is not in its features."""
    return featurizer.stages[0].transform_train(train)


def written_matrix(encoder, train: DataFrame) -> DataFrame:
    """What fits read many times, written once."""
    return write_and_read(encoder.transform_train(train).select("booking_id", LABEL, "weight", "features"), "matrix")


MODEL_KINDS = ("logistic", "forest", "gbt_shallow", "gbt_deep", "gbt_sub", *LEARNERS)


def classifier(kind: str, tag: str | None = None, seed: int = 42):
    """F09-F11, the MLlib learners; the second-order ones are those of :mod:`.boost`."""
    tag = tag or kind
    common = dict(featuresCol="features", labelCol=LABEL, weightCol="weight", predictionCol=f"pred_{tag}")
    if kind == "logistic":
        est = LogisticRegression(maxIter=50, regParam=0.01, elasticNetParam=0.0, threshold=THRESHOLD, **common)
    elif kind == "forest":
        # a row's nodes are kept from level to level: same trees, no walk from the root
        est = RandomForestClassifier(numTrees=30, maxDepth=8, seed=seed, cacheNodeIds=True, **common)
    elif kind == "gbt_shallow":
        est = GBTClassifier(maxDepth=3, maxIter=25, stepSize=0.2, seed=seed, **common)
    elif kind == "gbt_deep":
        est = GBTClassifier(maxDepth=6, maxIter=12, stepSize=0.2, seed=seed, **common)
    elif kind == "gbt_sub":
        est = GBTClassifier(maxDepth=5, maxIter=20, stepSize=0.2, subsamplingRate=0.7,
                            featureSubsetStrategy="sqrt", seed=seed, **common)
    else:
        raise ValueError(kind)
    est = est.setProbabilityCol(f"prob_{tag}").setRawPredictionCol(f"raw_{tag}")
    if kind != "logistic":
        # predicted class = argmax(p_i / t_i): cancel exactly when p1 >= 0.60
        est = est.setThresholds([1 - THRESHOLD, THRESHOLD])
    return est


def p1(col: str) -> Column:
    """P(cancel) from a probability vector column."""
    return vector_to_array(F.col(col))[1]


def fit_many(jobs: list, parallelism: int = 3) -> list:
    """Run independent fits from a small driver thread pool (like
    ``CrossValidator(parallelism=...)``): each fit is a distributed MLlib job;
    overlapping them keeps executors busy between a fit's short stages."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda job: job(), jobs))


def boost_rows(matrix: DataFrame, subset: int = 0) -> DataFrame:
    """A training matrix as the rows that :func:`boost.fit_many` reads."""
    return matrix.select(F.lit(subset).alias("subset"), F.col(LABEL).cast("double").alias("y"), F.col("weight").cast("double").alias("w"),
                         F.xxhash64("booking_id").alias("code"), vector_to_array("features").alias("x"))


TASK_ROWS = 1 << 18


def spread(df: DataFrame, key: str = "booking_id", rows: int = TASK_ROWS) -> DataFrame:
    """A written table in tasks of about ``rows`` rows, dealt by key.  Files pack
    millions of rows into a read task, which wide features, kept by MLlib, and
    attributions make many times larger."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, key) if tasks > df.rdd.getNumPartitions() else df


def packed(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """A table of few columns, put together from many small files, in as many tasks as
    there are cores, or more, of about ``rows`` rows: an optimizer that scans it a
    hundred times waits for its tasks' start, not for their rows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def beside(rows, most: int = 3) -> int:
    """How many MLlib fits on tables of so many rows run at once.  Each keeps its
    rows in memory, about 0.7 KB a row: small fits fill each other's gaps, large ones
    fill the cores alone and would push each other's rows to disk."""
    return max(1, min(most, most * 4 * TASK_ROWS // max(1, *rows, 1)))


def fit_kinds(encoders: dict, matrices: dict[int, DataFrame], kinds: dict[int, tuple]) -> dict:
    """(subset, kind) -> fitted stage.  All boosted models share their passes;
    the others are fitted beside each other."""
    boosted = [(s, kind) for s in kinds for kind in kinds[s] if kind in LEARNERS]
    others = [(s, kind) for s in kinds for kind in kinds[s] if kind not in LEARNERS]

    def all_boosted():
        if not boosted:
            return {}
        rows = None
        for s in sorted({s for s, _ in boosted}):
            part = boost_rows(matrices[s], s)
            rows = part if rows is None else rows.unionByName(part)
        enc = next(iter(encoders.values()))
        models = boost.fit_many(rows, [(s, LEARNERS[kind]) for s, kind in boosted], enc.binary_slots(), written=True, exclusive=enc.one_hot_slots(), slots=len(enc.slots()))
        return {job: m.named(job[1], THRESHOLD) for job, m in zip(boosted, models)}

    def all_others():
        return fit_many([lambda s=s, kind=kind: classifier(kind).fit(spread(matrices[s])) for s, kind in others],
                        beside({s: matrices[s].count() for s, _ in others}.values()))

    first, rest = fit_many([all_boosted, all_others], parallelism=2)
    return {**first, **dict(zip(others, rest))}


def fit_pipeline(train: DataFrame, kind: str, **params) -> PipelineModel:
    """Features + one classifier as one persistable PipelineModel."""
    enc = FeatureEncoder().fit(train)
    x = written_matrix(enc, train)
    if kind in LEARNERS:
        how = replace(LEARNERS[kind], **params)
        model = boost.fit_many(boost_rows(x), [(0, how)], enc.binary_slots(), written=True, exclusive=enc.one_hot_slots(), slots=len(enc.slots()))[0]
        return PipelineModel(stages=[enc, model.named(kind, THRESHOLD)])
    est = classifier(kind)
    return PipelineModel(stages=[enc, est.copy({est.getParam(k): v for k, v in params.items()}).fit(spread(x))])


def score(model: PipelineModel, df: DataFrame, kind: str, out: str = "p") -> DataFrame:
    return model.transform(df).withColumn(out, p1(f"prob_{kind}"))


def evaluate_scores(scored: DataFrame, p: str = "p", threshold: float = THRESHOLD) -> DataFrame:
    """One-row evaluation of a probability column: AUC, accuracy,
    precision, recall, F0.5 at the threshold, Brier."""
    s = write_and_read(scored.select(LABEL, F.col(p).alias("score")).withColumn("prediction", fx.decision("score", threshold)), "scores")
    m = ev.class_metrics(ev.confusion(s))
    auc = ev.auc_roc(s).select("auc_roc")
    br = ev.brier(s)
    return m.select("*", auc.scalar().alias("auc_roc"), br.scalar().alias("brier"))


def fit_and_evaluate(train: DataFrame, test: DataFrame, kind: str) -> DataFrame:
    """F09-F11 report: fit on the train part, evaluate on the test part."""
    model = fit_pipeline(train, kind)
    return evaluate_scores(score(model, test, kind)).select(F.lit(kind).alias("model"), "*")


def linear_weights(model) -> list[float]:
    """Coefficients of a fitted logistic model, one per feature slot."""
    return [float(w) for w in model.coefficients.toArray()]


# F12
VOTERS = ("logistic", "forest", "boost_level")


def fit_voting(encoder, matrix: DataFrame, kinds=VOTERS) -> list:
    """Members fitted on one written training matrix."""
    models = fit_kinds({0: encoder}, {0: matrix}, {0: tuple(kinds)})
    return [(kind, models[0, kind]) for kind in kinds]


def vote(members: list, feat: DataFrame, out: str = "p_vote") -> DataFrame:
    """Soft voting: mean of member probabilities.  Members run one after the
    other on the same frame (distinct output columns), so no join."""
    d = feat
    for k, m in members:
        d = m.transform(d).withColumn(f"p_{k}", p1(f"prob_{k}"))
    return d.withColumn(out, sum(F.col(f"p_{k}") for k, _ in members) / len(members))


# F13
STACK_BASES = ("boost_level", "boost_leaf", "boost_symmetric", "forest")
STACK_FOLDS = 4


def fit_on_subsets(folds: DataFrame, subsets: dict[int, list[int]], kinds: dict[int, tuple]) -> tuple[dict, dict]:
    """(encoders, models by (subset, kind)) of training sets that are unions of
    the rows' folds.  Every set's matrix is written once."""
    encoders = fit_subsets(folds, "fold", subsets)
    matrices = fit_many([lambda s=s: written_matrix(encoders[s], folds.filter(F.col("fold").isin(subsets[s]))) for s in subsets], parallelism=4)
    return encoders, fit_kinds(encoders, dict(zip(subsets, matrices)), kinds)


def base_scores(encoder, models: list, rows: DataFrame) -> DataFrame:
    """``rows`` with the probabilities of all ``models``."""
    return PipelineModel(stages=[encoder, *models]).transform(rows)


def fit_meta(rows: DataFrame, kinds=STACK_BASES) -> PipelineModel:
    """The logistic meta-learner over the bases' probabilities (``prob_stack``)."""
    pick = [VectorSlicer(inputCol=f"prob_{kind}", outputCol=f"p1_{kind}", indices=[1]) for kind in kinds]
    join = VectorAssembler(inputCols=[f"p1_{kind}" for kind in kinds], outputCol="meta_features")
    return Pipeline(stages=[*pick, join, LogisticRegression(
        featuresCol="meta_features", labelCol=LABEL, weightCol="weight", probabilityCol="prob_stack",
        rawPredictionCol="raw_stack", predictionCol="pred_stack", threshold=THRESHOLD)]).fit(packed(rows))


def _union(parts: list) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_stacking(train: DataFrame, kinds=STACK_BASES, k: int = STACK_FOLDS, beside=()) -> PipelineModel:
    """Stack as one persistable PipelineModel: features, base models, logistic
    meta-learner (``prob_stack``).  The meta-learner sees base probabilities of
    rows that neither the bases nor their encoders were fitted on.  Models
    ``beside`` are fitted and scored along, but not stacked."""
    folds = write_and_read(en.stratified_folds(train, k), "stack-folds")
    every = list(range(1, k + 1))
    subsets = {0: every, **{f: [g for g in every if g != f] for f in every}}
    encoders, models = fit_on_subsets(folds, subsets, {s: (*kinds, *beside) if s == 0 else tuple(kinds) for s in subsets})

    def meta_rows(f):
        d = base_scores(encoders[f], [models[f, kind] for kind in kinds], folds.filter(F.col("fold") == f))
        return write_and_read(d.select(LABEL, "weight", *[f"prob_{kind}" for kind in kinds]), "stack-meta")

    meta = fit_meta(_union(fit_many([lambda f=f: meta_rows(f) for f in every], parallelism=4)), kinds)
    return PipelineModel(stages=[encoders[0], *[models[0, kind] for kind in (*kinds, *beside)], *meta.stages])


# F16
RANKED = (*STACK_BASES, "logistic", "voting", "stack")


def nested_scores(folds: DataFrame, k: int, kinds=STACK_BASES) -> tuple[DataFrame, dict, dict, dict]:
    """Nested stacking with fits shared by pairs of folds.

    The bases are fitted once without each pair of folds {i, j}; their scores of
    i and of j are inner out-of-fold rows of outer folds j and i.  With the fits
    without one fold, which score the outer fold itself, that is k (k - 1) / 2 + k
    training sets instead of k * k, and k - 1 inner folds for each outer one.

    Returns the inner rows (``booking_id, fold, outer``, label, weight, base
    probabilities), the encoders, the models and the training sets (folds by
    number: f for all but fold f, 100 i + j for all but i and j)."""
    every = list(range(1, k + 1))
    pairs = [(i, j) for i in every for j in every if i < j]
    subsets = {f: [g for g in every if g != f] for f in every}
    subsets.update({100 * i + j: [g for g in every if g not in (i, j)] for i, j in pairs})
    encoders, models = fit_on_subsets(folds, subsets, {s: (*kinds, "logistic") if s < 100 else tuple(kinds) for s in subsets})

    def pair_rows(i, j):
        s = 100 * i + j
        d = base_scores(encoders[s], [models[s, kind] for kind in kinds], folds.filter(F.col("fold").isin(i, j)))
        outer = F.when(F.col("fold") == i, F.lit(j)).otherwise(F.lit(i))
        return write_and_read(d.select("booking_id", "fold", outer.alias("outer"), LABEL, "weight", *[f"prob_{kind}" for kind in kinds]), "cv-pair")

    inner = _union(fit_many([lambda p=p: pair_rows(*p) for p in pairs], parallelism=4))
    return inner, encoders, models, subsets


def cv_models(df: DataFrame, k: int = 5) -> DataFrame:
    """Per model x fold: F0.5, precision, recall on the held-out fold, for the
    five single models, their soft vote (logistic, forest, level-wise boosting)
    and the stack, whose inner folds are the other k - 1 (:func:`nested_scores`).
    Encoders and models are fitted on the other folds only."""
    folds = write_and_read(en.stratified_folds(df, k), "cv-folds")
    inner, encoders, models, _ = nested_scores(folds, k)

    def fold_scores(f):
        meta = fit_meta(inner.filter(F.col("outer") == f))
        single = [models[f, kind] for kind in (*STACK_BASES, "logistic")]
        d = meta.transform(base_scores(encoders[f], single, folds.filter(F.col("fold") == f)))
        p = {kind: p1(f"prob_{kind}") for kind in (*STACK_BASES, "logistic", "stack")}
        p["voting"] = sum(p[kind] for kind in VOTERS) / len(VOTERS)
        d = d.select(LABEL, "fold", *[v.alias(f"p_{m}") for m, v in p.items()])
        each = F.array(*[F.struct(F.lit(m).alias("model"), fx.decision(f"p_{m}").alias("prediction")) for m in RANKED])
        return write_and_read(d.select(LABEL, "fold", F.inline(each)).groupBy("model", "fold").agg(
            F.count_if((F.col(LABEL) == 0) & (F.col("prediction") == 1)).alias("fp"),
            F.count_if((F.col(LABEL) == 1) & (F.col("prediction") == 0)).alias("fn"),
            F.count_if((F.col(LABEL) == 1) & (F.col("prediction") == 1)).alias("tp")), "cv-fold")

    g = _union(fit_many([lambda f=f: fold_scores(f) for f in range(1, k + 1)], parallelism=3))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return write_and_read(g.select("model", "fold", safe_div(1.25 * tp, 1.25 * tp + 0.25 * fn + fp).alias("f05"),
                                   safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall")), "cv")


def write_table(df: DataFrame, kind: str) -> str:
    """Write to a new folder under the shared one (``spark.checkpoint.dir``)."""
    import uuid
    from ..session import shared_dir
    path = f"{shared_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_and_read(df: DataFrame, kind: str) -> DataFrame:
    """Cut lineage: write to the shared folder (``spark.checkpoint.dir``) and
    read back, so later use neither refits models nor depends on cached
    blocks of a lost executor."""
    return df.sparkSession.read.parquet(write_table(df, kind))


def remove_table(spark, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# F15
def cv_table(scored_folds: DataFrame, y: str = "is_canceled", pred: str = "prediction",
             fold: str = "fold") -> DataFrame:
    """Per-fold F0.5, precision, recall; mean and sample sd of F0.5 over the
    folds.  One aggregate by fold, then a window over the k fold rows."""
    yc, pc = F.col(y), F.col(pred)
    g = scored_folds.groupBy(fold).agg(
        F.count_if((yc == 0) & (pc == 1)).alias("fp"), F.count_if((yc == 1) & (pc == 0)).alias("fn"),
        F.count_if((yc == 1) & (pc == 1)).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    g = g.select(fold, safe_div(1.25 * tp, 1.25 * tp + 0.25 * fn + fp).alias("f05"),
                 safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"))
    w = Window.partitionBy(F.lit(0))
    return g.withColumns({"f05_mean": stable(F.avg("f05").over(w)),
                          "f05_sd": stable(F.stddev_samp("f05").over(w))})


def model_ranking(cv: DataFrame) -> DataFrame:
    """F16: mean and sample sd of F0.5 per model, ranked (one row per model)."""
    g = cv.groupBy("model").agg(F.avg("f05").alias("f05_mean"), F.stddev_samp("f05").alias("f05_sd"),
                                F.count(F.lit(1)).alias("folds"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.col("f05_mean").desc(), "model")).cast("long"))


# F17 / F18
TUNED = tuple(LEARNERS)


class SearchRows:
    """What every trial on ``df`` reads: ``k`` stratified folds, the encoders fitted
    on the training folds of each split, and their binned matrices, made once when
    first needed."""

    def __init__(self, df: DataFrame, k: int):
        self.df, self.k, self.every = df, k, list(range(1, k + 1))
        self.subsets = {f: [g for g in self.every if g != f] for f in self.every}

    @cached_property
    def folds(self) -> DataFrame:
        return write_and_read(en.stratified_folds(self.df, self.k), "search-folds")

    @cached_property
    def encoders(self) -> dict:
        return fit_subsets(self.folds, "fold", self.subsets)

    @cached_property
    def binned(self) -> boost.Binned:
        def rows(s):
            return boost_rows(written_matrix(self.encoders[s], self.folds.filter(F.col("fold").isin(self.subsets[s]))), s)

        enc = self.encoders[1]
        return boost.ready(_union(fit_many([lambda s=s: rows(s) for s in self.subsets])), enc.binary_slots(), "search", True, enc.one_hot_slots(), len(enc.slots()))


def trial_scores(df: DataFrame | SearchRows, trials: list[tuple[str, dict]], k: int) -> list[float]:
    """Mean F0.5 over ``k`` stratified folds of each trial (learner, parameters
    that differ from the learner's own).  Encoders are fitted on the training
    folds of each split; all trials of all splits share the boosting passes, at
    the learners' own rounds."""
    data = df if isinstance(df, SearchRows) else SearchRows(df, k)
    folds, every, encoders = data.folds, data.every, data.encoders
    jobs = [(f, replace(LEARNERS[kind], **params)) for f in every for kind, params in trials]
    models = boost.fit_ready(data.binned, jobs)

    def held(f):
        mine = models[(f - 1) * len(trials):f * len(trials)]
        d = encoders[f].transform(folds.filter(F.col("fold") == f))
        d = d.select(F.col(LABEL).alias("y"), F.posexplode(boost.margins(mine, F.col("features"))).alias("trial", "m"))
        cancel = 1.0 / (1.0 + F.exp(-F.col("m"))) >= THRESHOLD
        g = d.groupBy("trial").agg(F.count_if((F.col("y") == 0) & cancel).alias("fp"), F.count_if((F.col("y") == 1) & ~cancel).alias("fn"),
                                   F.count_if((F.col("y") == 1) & cancel).alias("tp"))
        return {r["trial"]: 1.25 * r["tp"] / (1.25 * r["tp"] + 0.25 * r["fn"] + r["fp"]) if r["tp"] else 0.0 for r in g.collect()}

    scores = fit_many([lambda f=f: held(f) for f in every])
    return [sum(s[t] for s in scores) / k for t in range(len(trials))]


class Trials:
    """Finished trials, kept in the shared folder under the data's stamp: a row
    per learner with all its parameters and number of folds.  A search runs only
    what no search, in this session or an earlier one, has run on this data."""

    SCHEMA = "learner string, growth string, folds int, f05 double"

    def __init__(self, df: DataFrame, stamp: str, k: int = 3):
        from ..session import shared_dir
        self.rows, self.k, self.spark = SearchRows(df, k), k, df.sparkSession
        self.path = f"{shared_dir(self.spark)}/trials-{stamp}"

    def _key(self, kind: str, params: dict) -> tuple:
        return kind, json.dumps(asdict(replace(LEARNERS[kind], **params)), sort_keys=True), self.k

    def finished(self) -> dict:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        return {(r["learner"], r["growth"], r["folds"]): r["f05"] for r in self.spark.read.schema(self.SCHEMA).parquet(self.path).collect()}

    def scores(self, trials: list[tuple[str, dict]]) -> list[float]:
        """Mean F0.5 of each trial; the missing ones share their passes."""
        known = self.finished()
        todo = list({self._key(*t): t for t in trials if self._key(*t) not in known}.values())
        if todo:
            new = {self._key(*t): float(s) for t, s in zip(todo, trial_scores(self.rows, todo, self.k))}
            self.spark.createDataFrame([(*key, s) for key, s in new.items()], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            known.update(new)
        return [known[self._key(*t)] for t in trials]

    def table(self, trials: list[tuple[str, dict]], method: str) -> DataFrame:
        rows = [(kind, method, ", ".join(f"{n}={v}" for n, v in sorted(params.items())), score)
                for (kind, params), score in zip(trials, self.scores(trials))]
        return self.spark.createDataFrame(rows, "model string, method string, params string, f05 double")


DEPTHS, STEPS = (2, 5), (0.05, 0.4)


def grid_trials(kinds=TUNED) -> list[tuple[str, dict]]:
    """the boosted models' depth x step."""
    return [(kind, {"depth": d, "step": s}) for kind in kinds for d in (2, 4) for s in (0.1, 0.3)]


def random_trials(n: int = 4, seed: int = 7, kinds=TUNED) -> list[tuple[str, dict]]:
    """seeded draws from the same space."""
    import random
    rnd = random.Random(seed)
    return [(kind, {"depth": rnd.randint(*DEPTHS), "step": round(rnd.uniform(*STEPS), 3)}) for kind in kinds for _ in range(n)]


def parzen_proposals(done: list[tuple[dict, float]], n: int, seed: int, share: float = 0.3, draws: int = 64) -> list[dict]:
    """``n`` parameter sets to try next, from finished ``(parameters, score)``.

    The best ``share`` of the trials and the rest each give a Parzen density
    (Gaussian kernels on the step's logarithm and on depth, and one kernel over
    the whole space).  Of ``draws`` draws from the density of the good ones the
    one of greatest density ratio is proposed; it then counts as a finished
    trial of the rest, so proposals that run side by side keep apart."""
    import math
    import random
    rnd = random.Random(seed)
    low, high = math.log(STEPS[0]), math.log(STEPS[1])
    point = lambda p: (float(p["depth"]), math.log(p["step"]))
    ranked = [point(p) for p, _ in sorted(done, key=lambda t: (-t[1], t[0]["depth"], t[0]["step"]))]
    cut = max(1, round(share * len(ranked)))
    good, rest = ranked[:cut], ranked[cut:]
    widths = 0.8, (high - low) / 6

    def density(x, points):
        kernel = lambda d, s: math.exp(-(d * d + s * s) / 2) / (2 * math.pi * widths[0] * widths[1])
        flat = 1 / ((DEPTHS[1] - DEPTHS[0] + 1) * (high - low))
        return (flat + sum(kernel((x[0] - a) / widths[0], (x[1] - b) / widths[1]) for a, b in points)) / (len(points) + 1)

    def draw():
        k = rnd.randrange(len(good) + 1)
        if k == len(good):
            return float(rnd.randint(*DEPTHS)), rnd.uniform(low, high)
        d, s = good[k]
        return (float(min(max(round(rnd.gauss(d, widths[0])), DEPTHS[0]), DEPTHS[1])), min(max(rnd.gauss(s, widths[1]), low), high))

    out = []
    for _ in range(n):
        best = max((draw() for _ in range(draws)), key=lambda x: density(x, good) / density(x, rest))
        rest.append(best)
        out.append({"depth": int(best[0]), "step": round(math.exp(best[1]), 3)})
    return out


def parzen_trials(store: Trials, start: list[tuple[str, dict]], rounds: int = 2, n: int = 2, seed: int = 7, kinds=TUNED) -> list[tuple[str, dict]]:
    """F19's third method: ``rounds`` times ``n`` proposals per learner from its
    finished trials, beginning with those of ``start``; a round's fits share
    their passes."""
    tried: list[tuple[str, dict]] = []
    for r in range(rounds):
        pool = [*start, *tried]
        scores = store.scores(pool)
        new = []
        for kind in kinds:
            done = [(p, s) for (name, p), s in zip(pool, scores) if name == kind]
            new += [(kind, p) for p in parzen_proposals(done, n, seed + r)]
        store.scores(new)
        tried += new
    return tried


# F19
def tuning_compare(results: DataFrame) -> DataFrame:
    """(model, method, f05) -> one row per model: best F0.5 per method as
    columns, and the method with the highest score (ties: method name)."""
    best = results.groupBy("model", "method").agg(F.max("f05").alias("f05"))
    wide = best.groupBy("model").pivot("method").agg(F.first("f05"))
    w = Window.partitionBy("model").orderBy(F.col("f05").desc(), F.col("method").asc())
    win = (best.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
           .select("model", F.col("method").alias("best_method"), F.col("f05").alias("best_f05")))
    return wide.join(win, "model")
