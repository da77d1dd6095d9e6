"""Diagnosis output table (the input of the policy layer).

Two producers share one output schema (``PREDICTION_COLUMNS``):

* ``class_share_predictions`` — counted from the data: for each (error code,
  method) the bucket that the train split holds most often, with its share as
  the confidence, applied to every failed payment. Plain SQL reproduces it.
* ``operators.models.diagnosis_scores`` — a fitted Spark ML forest.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.operators.features import customer_fail_history

SHARE_KEYS = ["error_code", "method"]
SHARE_PLACES = 3
SHARES_BROADCAST = 100_000

FEATURES = ["error_code", "amount", "method", "hour_of_day", "day_of_week", "customer_fail_count"]
LEAK_COLUMNS = ["error_reason", "error_description"]
PREDICTION_COLUMNS = ["payment_id", *FEATURES, "actual_bucket", "predicted_bucket", "confidence"]


def diagnosis_features(failed: DataFrame) -> DataFrame:
    """PRJ-2: leak-free feature projection (+ id and label)."""
    feats = customer_fail_history(failed)
    out = feats.select("payment_id", *FEATURES, F.col("root_cause_bucket").alias("actual_bucket"))
    assert not set(LEAK_COLUMNS) & set(out.columns)
    return out


def class_shares(failed: DataFrame) -> DataFrame:
    """(error_code, method, predicted_bucket, confidence): most frequent bucket of the train
    split (ties: smallest name) and its share."""
    from dunning.operators.evaluation import with_split
    labelled = failed.select("payment_id", *SHARE_KEYS, F.col("root_cause_bucket").alias("actual_bucket"))
    train = with_split(labelled).filter((F.col("split") == "train") & F.col("actual_bucket").isNotNull())
    counts = train.groupBy(*SHARE_KEYS, "actual_bucket").agg(F.count(F.lit(1)).alias("n"))
    return (counts.groupBy(*SHARE_KEYS)
            .agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("actual_bucket").alias("b"))).alias("top"), F.sum("n").alias("total"))
            .select(*SHARE_KEYS, F.col("top.b").alias("predicted_bucket"),
                    F.round(-F.col("top.m") / F.col("total"), SHARE_PLACES).alias("confidence")))


def with_class_shares(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` with predicted_bucket and confidence; both null where the train split lacks the keys.

    One share per (error code, method): counted, and broadcast up to ``SHARES_BROADCAST`` rows, so that
    no failed payment is shuffled by those few keys; beyond it a plain join."""
    s = shares.select(*[F.col(k).alias(f"__{k}") for k in SHARE_KEYS], "predicted_bucket", "confidence")
    s = s.persist(StorageLevel.MEMORY_AND_DISK)
    few = s.limit(SHARES_BROADCAST + 1).count() <= SHARES_BROADCAST
    on = F.lit(True)
    for k in SHARE_KEYS:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(F.broadcast(s) if few else s, on, "left").drop(*[f"__{k}" for k in SHARE_KEYS])


def held_out(predictions: DataFrame) -> DataFrame:
    """The predictions of the test split: rows that no class share was counted on."""
    from dunning.operators.evaluation import with_split
    return with_split(predictions).where(F.col("split") == "test").drop("split")


def class_share_predictions(failed: DataFrame) -> DataFrame:
    return with_class_shares(diagnosis_features(failed), class_shares(failed)).select(*PREDICTION_COLUMNS)


def class_share_scores(failed: DataFrame) -> DataFrame:
    """What the policy reads (id, amount, bucket, confidence), without the history windows."""
    rows = failed.select("payment_id", "amount", *SHARE_KEYS)
    return with_class_shares(rows, class_shares(failed)).select("payment_id", "amount", "predicted_bucket", "confidence")
