"""Spark ML models (ML-3..10, AGG-13, SRT-2).

Diagnosis: failed payment -> root-cause bucket with a confidence.
  features: error_code, method (one-hot; an unseen value encodes as all
  zeros: StringIndexer(keep) puts it on the last index, which
  OneHotEncoder(dropLast) drops), amount, hour_of_day, day_of_week,
  customer_fail_count; RandomForest(200 trees, depth 8, seed 42) weighted
  by balanced class weights; LogisticRegression(maxIter=1000) baseline.
Detection: payment -> probability it fails (risk score), flag at 0.5.

Training runs distributed (tree statistics are aggregated per partition);
the training frame is persisted because every iteration rescans it. Rows are dealt evenly
over tasks and like rows lie together in them (``laid_out``): a level of a forest takes as long
as its fullest task, and neighbours that go the same ways through 200 trees find them in cache.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.functions.expr import salted_hash8
from dunning.operators import evaluation as EV
from dunning.operators.forest import CellForest

CATEGORICAL = ["error_code", "method"]
NUMERIC = ["amount", "hour_of_day", "day_of_week", "customer_fail_count"]
RISK_NUMERIC = ["amount", "hour_of_day", "day_of_week", "customer_prior_fail_rate", "customer_txn_count_so_far"]

NUM_TREES = 200
MAX_DEPTH = 8
SEED = 42
LR_MAX_ITER = 1000
ROWS_PER_TASK = 250_000


def _features(categorical, numeric):
    idx = StringIndexer(inputCols=categorical, outputCols=[c + "_idx" for c in categorical], handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[c + "_idx" for c in categorical], outputCols=[c + "_ohe" for c in categorical],
                        dropLast=True)
    asm = VectorAssembler(inputCols=[c + "_ohe" for c in categorical] + numeric, outputCol="features",
                          handleInvalid="keep")
    return [idx, ohe, asm]


def _numeric(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def with_class_weights(train: DataFrame, label: str = "actual_bucket") -> DataFrame:
    """Attach AGG-13 weights: a k-row table, broadcast (bounded by class count)."""
    w = EV.class_weights(train, label).select(F.col("label").alias(label), F.col("weight").alias("class_weight"))
    return train.join(F.broadcast(w), label, "left")


def diagnosis_pipeline(num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH, seed: int = SEED,
                       model: str = "forest") -> Pipeline:
    label = StringIndexer(inputCol="actual_bucket", outputCol="label", handleInvalid="skip")
    if model == "cell_forest":
        clf = CellForest(num_trees, max_depth, seed, weight="class_weight")
    elif model == "forest":
        clf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                     weightCol="class_weight", labelCol="label", featuresCol="features")
    else:
        clf = LogisticRegression(maxIter=LR_MAX_ITER, labelCol="label", featuresCol="features")
    return Pipeline(stages=[*_features(CATEGORICAL, NUMERIC), label, clf])


def laid_out(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` dealt evenly over two tasks a core, more from ``ROWS_PER_TASK`` rows a task on; rows that are alike in the
    columns that hold few values lie together."""
    order = [c for c in (*CATEGORICAL, "actual_bucket", "actual_at_risk", "hour_of_day", "day_of_week", "customer_fail_count",
                         "customer_txn_count_so_far", "customer_prior_fail_rate", "amount") if c in rows.columns]
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / ROWS_PER_TASK))
    return rows.repartition(tasks).sortWithinPartitions(*order)


def split(df: DataFrame, label: str = "actual_bucket") -> tuple[DataFrame, DataFrame]:
    """ML-3 train / test. The split table (one row per labelled row, like the
    other layer products) is persisted once, so the exact per-class ranking
    runs once for both sides and for every scoring pass over the test rows."""
    s = laid_out(EV.with_split(df, label), df.count()).persist(StorageLevel.MEMORY_AND_DISK)
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


def split_diagnosis(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ML-3 for the diagnosis models; one split serves all of them."""
    return split(_numeric(features, NUMERIC))


def fit_train(train: DataFrame, model: str = "forest", **kw) -> PipelineModel:
    """ML-4..6 on the train side of ``split_diagnosis``."""
    train = with_class_weights(train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return diagnosis_pipeline(model=model, **kw).fit(train)
    finally:
        train.unpersist()


def fit_diagnosis(features: DataFrame, model: str = "forest", **kw) -> tuple[PipelineModel, DataFrame]:
    """ML-3..6: fit on the train split; returns (model, test split)."""
    train, test = split_diagnosis(features)
    return fit_train(train, model, **kw), test


def score_diagnosis(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    """ML-7: predicted bucket + confidence (= top class probability, FN-22)."""
    labels = fitted.stages[-2].labels
    out = fitted.transform(rows if "class_weight" in rows.columns else rows.withColumn("class_weight", F.lit(1.0)))
    out = IndexToString(inputCol="prediction", outputCol="predicted_bucket", labels=labels).transform(out)
    return out.select("payment_id", "actual_bucket", "predicted_bucket",
                      F.array_max(vector_to_array("probability")).alias("confidence"))


def feature_importance(fitted: PipelineModel, top: int | None = 10) -> list[tuple[str, float]]:
    """ML-8 / SRT-2: the ``top`` features (all for None), by importance, then name."""
    forest = fitted.stages[-1]
    imp = forest.featureImportances.toArray().tolist()
    return sorted(zip(_feature_names(fitted), imp), key=lambda t: (-t[1], t[0]))[:top]


def _feature_names(fitted: PipelineModel) -> list[str]:
    names: list[str] = []
    indexer = fitted.stages[0]
    for col, labels in zip(CATEGORICAL, indexer.labelsArray):
        names += [f"{col}_{v}" for v in labels]  # dropLast removes only the 'unseen' slot
    return names + NUMERIC


def fit_encoder(train: DataFrame) -> PipelineModel:
    """ML-4 alone: the feature stages of the diagnosis pipeline."""
    return Pipeline(stages=_features(CATEGORICAL, NUMERIC)).fit(_numeric(train, NUMERIC))


def encoded(encoder: PipelineModel, rows: DataFrame) -> DataFrame:
    """The feature vector of every row by name: ``active`` lists the one-hot slots that are 1 (none for a value
    that the encoder has not seen, or null), joined by commas; the numeric slots follow under their own names."""
    names = _feature_names(encoder)
    slots = F.col("__slots")
    hot = [F.when(slots[i] == 1, F.lit(n)) for i, n in enumerate(names[:-len(NUMERIC)])]
    numbers = [slots[len(hot) + i].alias(n) for i, n in enumerate(NUMERIC)]
    out = encoder.transform(_numeric(rows, NUMERIC)).withColumn("__slots", vector_to_array("features"))
    return out.select("payment_id", F.concat_ws(",", *hot).alias("active"), *numbers)


def fit_risk(features: DataFrame, num_trees: int = 50, max_depth: int = MAX_DEPTH, seed: int = SEED):
    """ML-10: binary failure-risk model over all payments (label actual_at_risk)."""
    data = _numeric(features, RISK_NUMERIC).withColumn("label", F.col("actual_at_risk").cast("double"))
    train, test = split(data, "actual_at_risk")
    pipe = Pipeline(stages=[*_features(["method"], RISK_NUMERIC),
                            RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed)])
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = pipe.fit(train)
    finally:
        train.unpersist()
    return fitted, test


def score_risk(fitted: PipelineModel, rows: DataFrame, threshold: float = EV.RISK_FLAG_THRESHOLD) -> DataFrame:
    out = fitted.transform(rows)
    score = vector_to_array("probability")[1]
    return out.select("payment_id", "actual_at_risk", score.alias("risk_score"),
                      (score >= threshold).cast("int").alias("flagged_at_risk"))


FOLDS = 3


def with_fold(rows: DataFrame, folds: int = FOLDS, id_col: str = "payment_id") -> DataFrame:
    """``fold`` 0 to folds - 1 by a salted hash of the id: equal ids share a fold, at any size."""
    return rows.withColumn("fold", F.pmod(salted_hash8(f"fold|{SEED}|", F.coalesce(F.col(id_col), F.lit("\u0000null"))), F.lit(folds)).cast("int"))


def cross_fitted(rows: DataFrame, fit: Callable[[DataFrame], PipelineModel], score: Callable[[PipelineModel, DataFrame], DataFrame],
                 folds: int = FOLDS) -> DataFrame:
    """Scores of every row (ML-7 / ML-10), each by a model fitted on the other folds only.

    The folds are kept while ``folds`` models are fitted; scoring is one map per fold."""
    held = laid_out(with_fold(rows, folds), rows.count()).persist(StorageLevel.MEMORY_AND_DISK)
    scored = [score(fit(held.where(F.col("fold") != k)), held.where(F.col("fold") == k)).withColumn("fold", F.lit(k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, scored)


def cross_fitted_diagnosis(features: DataFrame, folds: int = FOLDS, **kw) -> DataFrame:
    """Predicted bucket and confidence of every failed payment."""

    def fit(train: DataFrame) -> PipelineModel:
        return diagnosis_pipeline(model="cell_forest", **kw).fit(with_class_weights(train.where(F.col("actual_bucket").isNotNull())))

    return cross_fitted(_numeric(features, NUMERIC), fit, score_diagnosis, folds)


def cross_fitted_risk(features: DataFrame, folds: int = FOLDS, num_trees: int = 50, max_depth: int = MAX_DEPTH, seed: int = SEED) -> DataFrame:
    """Risk score and flag of every payment."""
    data = _numeric(features, RISK_NUMERIC).withColumn("label", F.col("actual_at_risk").cast("double"))

    def fit(train: DataFrame) -> PipelineModel:
        forest = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed)
        return Pipeline(stages=[*_features(["method"], RISK_NUMERIC), forest]).fit(train)

    return cross_fitted(data, fit, score_risk, folds)


def save(fitted: PipelineModel, path: str) -> None:
    """ML-9."""
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importance_frame(spark: SparkSession, pairs: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(pairs, "feature string, importance double")
