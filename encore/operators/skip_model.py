"""Skip prediction on songs (M1-M9): distributed MLlib pipeline, split and metrics.

Features: two numeric (median-imputed, standardised), three categorical (one-hot; a label not
seen in training encodes to all zeros), three booleans passed through as 0/1. Class-balanced
logistic regression with L2 strength C = 1: MLlib minimises the weighted *mean* loss plus
lambda/2 |w|^2, so lambda = 1 / (C * sum of weights) = 1 / n_train with balanced weights
(they sum to n_train); the intercept is not penalised in either formulation.

The loss is strictly convex, so its one minimum is what every solver is to find. Up to ``NEWTON_WIDTH``
encoded features it is found to rounding by Newton steps: tasks add up loss, gradient and Hessian of
their rows, Spark sums those by position, and the driver solves one small system a step. Beyond that width, where
a Hessian a task would outgrow what the rows are worth, MLlib's L-BFGS goes to the same minimum.

The split is a deterministic stratified 75/25: every row gets a seeded hash that any engine with MD5
can repeat; inside each class the hash slots (65,536 of them) up to the one where a quarter of the
class is reached form the test set. No per-class sort, no collection of a class on one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.session import small_splits
from encore.sources import fs

# The model's feature lists.
FEATURES_NUMERIC = ["play_minutes", "listening_hour"]
FEATURES_CATEGORICAL = ["platform", "reason_start", "reason_end"]
FEATURES_BOOLEAN = ["shuffle", "offline", "incognito_mode"]
TEST_FRACTION = 0.25
SEED = 42
MAX_ITER = 200
TOLERANCE = 1e-10  # relative change of the loss; far below what moves a coefficient by 1e-4
C_INVERSE_REG = 1.0
NEWTON_WIDTH = 200  # at most 20,100 sums a task and step
NEWTON_STEPS = 30  # quadratic convergence takes 5 to 8
NEWTON_GRADIENT = 1e-12  # largest component of the mean gradient at which the fit ends
KEPT = StorageLevel.DISK_ONLY  # rows that several passes read stream from disk; in memory they would fill any heap as the log grows


@dataclass
class SkipModel:
    """Fitted feature stages and the classifier's weights."""

    features: PipelineModel
    coefficients: np.ndarray
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``features``, ``probability`` (of label 1) and ``prediction``, all inside the JVM."""
        products = F.zip_with(vector_to_array("features"), F.lit([float(v) for v in self.coefficients]), lambda a, b: a * b)
        margin = F.aggregate(products, F.lit(float(self.intercept)), lambda total, v: total + v)
        return (
            self.features.transform(df)
            .withColumn("probability", 1.0 / (1.0 + F.exp(-margin)))
            .withColumn("prediction", (F.col("probability") > 0.5).cast("double"))
        )

    def feature_names(self) -> list[str]:
        """Names of ``coefficients``: a category's value follows its column; None for the slot of unseen values."""
        labels = self.features.stages[3].labelsArray
        encoded = [None if v is None else f"{c}={v}" for c, values in zip(FEATURES_CATEGORICAL, labels) for v in [*values, None]]
        return FEATURES_NUMERIC + encoded + FEATURES_BOOLEAN


@dataclass
class SkipModelResult:
    status: str
    model: SkipModel | None = None
    scored: DataFrame | None = None  # test rows: label, prediction, probability
    n_train: int = 0
    n_test: int = 0


def model_frame(plays: DataFrame) -> DataFrame:
    """Songs with label and typed features; a row hash for the split."""
    s = plays.where(F.col("is_song"))
    cols = [F.col(c).cast("double").alias(c) for c in FEATURES_NUMERIC]
    cols += [F.col(c).cast("string").alias(c) for c in FEATURES_CATEGORICAL]
    cols += [F.col(c).cast("double").alias(c) for c in FEATURES_BOOLEAN]
    ident = F.concat_ws("|", F.lit(str(SEED)), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("ms_played").cast("long"),
                        "master_metadata_track_name", "platform", "reason_start", "reason_end", "source_file")
    return s.select(
        *cols,
        F.col("is_skipped").cast("double").alias("label"),
        F.conv(F.substring(F.md5(ident), 1, 8), 16, 10).cast("long").alias("_h"),  # 32 bits
    )


def _slot():
    return F.shiftright("_h", 16)


def class_cuts(df: DataFrame, label: str = "label", test_fraction: float = TEST_FRACTION) -> DataFrame:
    """Per class: ``n`` rows, ``cut`` (the last hash slot of the test set) and ``n_test``."""
    slots = df.groupBy(label, _slot().alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(label).orderBy("slot")  # at most 65,536 slots a class
    slots = slots.select(label, "slot", F.sum("c").over(up).alias("upto"), F.sum("c").over(Window.partitionBy(label)).alias("n"))
    reached = slots.where(F.col("upto") >= F.col("n") * test_fraction)
    first = reached.groupBy(label).agg(F.min("n").alias("n"), F.min("slot").alias("cut"), F.min("upto").alias("n_test"))
    return first


def stratified_split(df: DataFrame, label: str = "label", test_fraction: float = TEST_FRACTION):
    """``(train, test)`` by each class's cut; the cuts (one number per class) are fetched once, so both
    frames are plain filters."""
    return _split(df, {r[label]: r["cut"] for r in class_cuts(df, label, test_fraction).collect()}, label)


def _split(df: DataFrame, cuts: dict, label: str = "label"):
    cut = F.lit(None).cast("long")
    for k, v in cuts.items():
        cut = F.when(F.col(label) == F.lit(k), F.lit(v)).otherwise(cut)
    return df.where(_slot() > cut), df.where(_slot() <= cut)


def build_pipeline(reg_param: float) -> Pipeline:
    imputed = [f"{c}_imp" for c in FEATURES_NUMERIC]
    stages = [
        Imputer(strategy="median", inputCols=FEATURES_NUMERIC, outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_num_std", withMean=True, withStd=True),
    ]
    ohe_out = [f"{c}_ohe" for c in FEATURES_CATEGORICAL]
    # one pass indexes all three categorical columns
    stages.append(StringIndexer(inputCols=FEATURES_CATEGORICAL, outputCols=[f"{c}_idx" for c in FEATURES_CATEGORICAL],
                                handleInvalid="keep"))
    # A label not seen in training falls into the indexer's extra slot, whose column is zero in all
    # training rows and so has no weight; dropLast drops the slot after it.
    stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in FEATURES_CATEGORICAL], outputCols=ohe_out,
                                dropLast=True, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=["_num_std"] + ohe_out + FEATURES_BOOLEAN, outputCol="features",
                                  handleInvalid="keep"))
    stages.append(LogisticRegression(featuresCol="features", labelCol="label", weightCol="_w", maxIter=MAX_ITER,
                                     regParam=reg_param, elasticNetParam=0.0, standardization=False, tol=TOLERANCE,
                                     fitIntercept=True))
    return Pipeline(stages=stages)


def _partial_sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums by position: loss, gradient, and the upper triangle of the Hessian."""
    d = len(weights)
    loss, grad, hess = 0.0, np.zeros(d), np.zeros((d, d))
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "_w"))
        values = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, d - 1)
        x = np.hstack([values, np.ones((n, 1))])
        z = x @ weights
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        loss += float(w @ (np.logaddexp(0.0, z) - y * z))
        grad += x.T @ (w * (p - y))
        hess += (x * (w * p * (1.0 - p))[:, None]).T @ x
    values = np.concatenate([[loss], grad, hess[np.triu_indices(d)]])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["position", "value"])


def newton_fit(vectors: DataFrame, width: int, ridge: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise the weighted mean log-loss of ``x`` (array), ``label``, ``_w``
    plus ``ridge / 2 |coefficients|^2``. A step that does not lower the loss is halved."""
    d = width + 1
    penalty = np.append(np.full(width, ridge), 0.0)
    total = float(vectors.agg(F.sum("_w")).first()[0])
    best, weights, step = np.inf, np.zeros(d), np.zeros(d)
    for _ in range(NEWTON_STEPS):
        sums = vectors.mapInArrow(lambda it, at=weights: _partial_sums(it, at), "position long, value double")
        rows = sums.groupBy("position").agg(F.sum("value").alias("value")).toPandas()  # bounded by NEWTON_WIDTH
        v = np.zeros(1 + d + d * (d + 1) // 2)
        v[rows["position"].to_numpy()] = rows["value"].to_numpy() / total
        loss = v[0] + float(penalty @ (weights * weights)) / 2
        if not loss <= best + 1e-12 * abs(best):
            step = step / 2
            weights = weights - step
            continue
        best = loss
        grad = v[1:1 + d] + penalty * weights
        if np.abs(grad).max() <= NEWTON_GRADIENT:
            break
        hess = np.zeros((d, d))
        hess[np.triu_indices(d)] = v[1 + d:]
        hess = hess + np.triu(hess, 1).T + np.diag(penalty)
        step = -np.linalg.solve(hess, grad)
        weights = weights + step
    return weights[:-1], float(weights[-1])


def train_skip_model(plays: DataFrame) -> SkipModelResult:
    """The log is read in small pieces: a task then reads again at every step the vectors of few rows, however
    large the log is. Executors keep rows on disk only."""
    with small_splits(plays.sparkSession):
        return _train(plays)


def _train(plays: DataFrame) -> SkipModelResult:
    data = model_frame(plays)
    cuts = class_cuts(data).collect()  # <= 2 rows; they hold the sizes of both sets too
    counts = {r["label"]: r["n"] for r in cuts}
    if len(counts) < 2 or min(counts.values()) < 2:
        return SkipModelResult("insufficient_data")
    train, test = _split(data, {r["label"]: r["cut"] for r in cuts})
    n_cls = {r["label"]: r["n"] - r["n_test"] for r in cuts}
    n_train = sum(n_cls.values())
    if min(n_cls.values()) < 1:
        return SkipModelResult("insufficient_data")
    w = F.when(F.col("label") == 1.0, F.lit(n_train / (2.0 * n_cls[1.0]))).otherwise(F.lit(n_train / (2.0 * n_cls[0.0])))
    ridge = 1.0 / (C_INVERSE_REG * n_train)
    stages = build_pipeline(ridge).getStages()
    train = train.withColumn("_w", w).persist(KEPT)
    try:
        # Feature stages first; the classifier's passes then read kept feature vectors
        # instead of re-running imputation, scaling and encoding on every iteration.
        features = Pipeline(stages=stages[:-1]).fit(train)
        width = len(FEATURES_NUMERIC) + sum(len(x) + 1 for x in features.stages[3].labelsArray) + len(FEATURES_BOOLEAN)
        narrow = width <= NEWTON_WIDTH
        x = vector_to_array("features").alias("x") if narrow else F.col("features")
        vectors = features.transform(train).select(x, "label", "_w").persist(KEPT)
        try:
            if narrow:
                coefficients, intercept = newton_fit(vectors, width, ridge)
            else:
                classifier = stages[-1].fit(vectors)
                coefficients, intercept = classifier.coefficients.toArray(), classifier.intercept
        finally:
            vectors.unpersist()
    finally:
        train.unpersist()
    model = SkipModel(features, coefficients, intercept)
    scored = model.transform(test).select("label", "prediction", "probability")
    return SkipModelResult("ok", model, scored, n_train, int(sum(counts.values()) - n_train))


def metrics(scored: DataFrame) -> DataFrame:
    """One row: n_test, accuracy, roc_auc (exact: no binning of the scores). The area is the share of pairs of one row of
    each class that the score puts in order, equal scores half. Rows are added up by score first; the scores are then dealt to
    tasks by ranges, and a range needs of all lower ones only how many rows of class 0 they hold. Without rows of a class
    the curve's fixed ends (0, 0) and (1, 1) give 1 (no class 0), 0 (no class 1) or 0.5 (neither)."""
    spark = scored.sparkSession
    counts = scored.groupBy("probability").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == F.col("prediction")).alias("hits"),
    )
    path = fs.temporary(spark, "scores")
    counts = counts.repartitionByRange("probability").withColumn("_part", F.spark_partition_id())
    counts.write.parquet(path)  # once, so that the ranges are the same for both uses
    neg = F.col("n") - F.col("pos")
    below = Window.partitionBy("_part").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        spark.read.schema(counts.schema).parquet(path)
        .withColumn("below", F.coalesce(F.sum(neg).over(below), F.lit(0)))
        .groupBy("_part")
        .agg(*[F.sum(c).alias(c) for c in ("n", "pos", "hits")], F.sum(F.col("pos") * (F.col("below") + neg / 2.0)).alias("pairs"))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    lower = F.coalesce(F.sum(neg).over(before), F.lit(0))
    total = ranges.withColumn("pairs", F.col("pairs") + F.col("pos").cast("double") * lower).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "pos", "hits")], F.sum("pairs").alias("pairs"))
    area = (
        F.when(F.col("n") == 0, 0.5).when(neg == 0, 1.0).when(F.col("pos") == 0, 0.0)
        .otherwise(F.col("pairs") / F.greatest(F.col("pos").cast("double") * neg, F.lit(1.0)))
    )
    return total.select(
        F.col("n").alias("n_test"),
        F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")).alias("accuracy"),
        area.alias("roc_auc"),
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg`` with precision, recall,
    f1_score, support; a zero denominator gives 0."""
    c = scored.agg(
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp"),
        F.count_if((F.col("label") == 0) & (F.col("prediction") == 1)).alias("fp"),
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 0)).alias("fn"),
        F.count_if((F.col("label") == 0) & (F.col("prediction") == 0)).alias("tn"),
    )

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ["tp", "fp", "fn", "tn"])
    p1, r1 = div(tp, tp + fp), div(tp, tp + fn)
    p0, r0 = div(tn, tn + fn), div(tn, tn + fp)
    m = c.select(
        p0.alias("p0"), r0.alias("r0"), div(2 * p0 * r0, p0 + r0).alias("f0"), (tn + fp).alias("s0"),
        p1.alias("p1"), r1.alias("r1"), div(2 * p1 * r1, p1 + r1).alias("f1"), (tp + fn).alias("s1"),
        div(tp + tn, tp + tn + fp + fn).alias("acc"), (tp + tn + fp + fn).alias("n"),
    )
    return m.select(F.expr("""stack(5,
        '0', p0, r0, f0, CAST(s0 AS DOUBLE),
        '1', p1, r1, f1, CAST(s1 AS DOUBLE),
        'accuracy', acc, acc, acc, CAST(n AS DOUBLE),
        'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS DOUBLE),
        'weighted avg', try_divide(p0 * s0 + p1 * s1, n), try_divide(r0 * s0 + r1 * s1, n),
                        try_divide(f0 * s0 + f1 * s1, n), CAST(n AS DOUBLE))
        AS (label, precision, recall, f1_score, support)"""))
