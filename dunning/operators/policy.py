"""Gated recovery policy (DEC-1..3, JON-5) as bulk column expressions.

Gates, first match wins:
  1. confidence < threshold                      -> escalate (low_confidence)
  2. predicted bucket is escalate_human          -> escalate (escalate_bucket)
  3. amount > high value and confidence < 0.75   -> escalate (high_value)
  4. otherwise attempts so far >= bucket cap     -> escalate (attempt_cap)
The cap reported is that of the bucket after gates 1-3; the action and the
cool-down come from the bucket after gate 4. Rules come from a broadcast
rules table (fixed size), never a per-row Python call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.functions.expr import dec2_text, round2_text, ts_text
from dunning.operators.rules import (ACTION_REASONS, RETRY_ACTIONS, PolicyParams, bucket_rules,
                                     small)

DECISION_COLUMNS = ["payment_id", "diagnosed_bucket", "confidence", "final_bucket_used", "action",
                    "reason", "reason_code", "attempt_number", "max_attempts_allowed", "escalate",
                    "retry_at"]


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """attempts so far per payment (partial aggregation; hot ids are fine)."""
    return attempts.groupBy("payment_id").agg(F.count(F.lit(1)).cast("int").alias("attempt_count"))


def decide(spark: SparkSession, preds: DataFrame, params: PolicyParams | None = None,
           attempts: DataFrame | None = None) -> DataFrame:
    p = params or PolicyParams()
    df = preds
    if attempts is not None:
        df = df.join(attempt_counts(attempts), "payment_id", "left")
    if "attempt_count" not in df.columns:
        df = df.withColumn("attempt_count", F.lit(0))
    df = df.withColumn("attempt_count", F.coalesce(F.col("attempt_count").cast("int"), F.lit(0)))

    conf = F.col("confidence")
    gate = (F.when(conf < p.confidence_threshold, F.lit("low_confidence"))
             .when(F.col("predicted_bucket") == "escalate_human", F.lit("escalate_bucket"))
             .when((F.col("amount") > F.lit(p.high_value_threshold))
                   & (conf < p.high_value_min_confidence), F.lit("high_value")))
    df = df.withColumn("__gate", gate).withColumn(
        "__bucket3",
        F.when(F.col("__gate").isin("low_confidence", "high_value"), F.lit("escalate_human"))
         .otherwise(F.col("predicted_bucket")))

    rules = small(bucket_rules(spark, p))
    df = (df.join(rules.select(F.col("rule_bucket").alias("__bucket3"),
                               F.col("rule_max_attempts").alias("__cap")), "__bucket3", "left")
            .withColumn("__cap", F.coalesce(F.col("__cap"), F.lit(0))))
    df = df.withColumn("__cap_hit", F.coalesce(F.col("__gate").isNull() & (F.col("attempt_count") >= F.col("__cap")),
                                               F.lit(False)))
    cap_hit = F.col("__cap_hit")
    df = (df.withColumn("final_bucket_used",
                        F.when(cap_hit, F.lit("escalate_human")).otherwise(F.col("__bucket3")))
            .withColumn("__gate", F.when(cap_hit, F.lit("attempt_cap")).otherwise(F.col("__gate"))))
    df = (df.join(rules.select(F.col("rule_bucket").alias("final_bucket_used"),
                               F.col("rule_action").alias("__action"),
                               F.col("rule_cooldown_hours").alias("__cool")), "final_bucket_used", "left"))
    action = F.coalesce(F.col("__action"), F.lit("escalate_human"))
    df = df.withColumn("action", action)

    default_reason = F.create_map(*[x for kv in ACTION_REASONS.items() for x in map(F.lit, kv)])
    reason = (F.when(F.col("__gate") == "low_confidence",
                     F.concat(F.lit("low_confidence:"), round2_text(conf), F.lit(f"<{p.confidence_threshold}")))
               .when(F.col("__gate") == "high_value",
                     F.concat(F.lit("high_value:amount="), dec2_text("amount"), F.lit(",confidence="), round2_text(conf)))
               .when(F.col("__gate") == "attempt_cap",
                     F.concat(F.lit("attempt_cap:"), F.coalesce(F.col("predicted_bucket"), F.lit("")), F.lit("="),
                              F.col("__cap").cast("string")))
               .otherwise(F.coalesce(default_reason[F.col("action")], F.lit(""))))
    reason_code = F.when(F.col("__gate").isin("low_confidence", "high_value", "attempt_cap"),
                         F.col("__gate")).otherwise(F.lit("default"))
    cool_secs = (F.coalesce(F.col("__cool"), F.lit(0.0)) * 3600).cast("long")
    retry_at = F.when(F.col("action").isin(*RETRY_ACTIONS),
                      ts_text(F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(p.as_of))) + cool_secs)))
    return df.select(
        "payment_id",
        F.col("predicted_bucket").alias("diagnosed_bucket"),
        F.round(conf, 3).alias("confidence"),
        "final_bucket_used",
        "action",
        reason.alias("reason"),
        reason_code.alias("reason_code"),
        (F.col("attempt_count") + 1).alias("attempt_number"),
        F.col("__cap").alias("max_attempts_allowed"),
        F.col("__gate").isNotNull().alias("escalate"),
        retry_at.alias("retry_at"),
    )


def action_summary(decisions: DataFrame) -> DataFrame:
    """AGG-1 / QRY-5: action frequency, descending, ties by action."""
    return (decisions.filter(F.col("action").isNotNull()).groupBy("action")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("action")))  # T8: ties by key (a handful of rows)


def action_labels(decisions: DataFrame) -> DataFrame:
    """AGG-2: client view — null action counted as 'unknown', display label."""
    k = F.coalesce(F.col("action"), F.lit("unknown"))
    return (decisions.groupBy(k.alias("action")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("label", F.regexp_replace("action", "_", " "))
            .orderBy(F.desc("count"), F.asc("action")))  # a handful of rows


def escalation_share(decisions: DataFrame) -> DataFrame:
    """AGG-12: escalated / total."""
    return decisions.agg(F.count_if(F.col("escalate")).alias("escalated"),
                         F.count(F.lit(1)).alias("decisions"))


def decision_preview(decisions: DataFrame, n: int = 8) -> DataFrame:
    """SRT-3: first n decisions by id with the chosen columns (a top-k report:
    TakeOrderedAndProject, no full sort)."""
    return (decisions.select("payment_id", "diagnosed_bucket", "confidence", "action", "reason")
            .orderBy("payment_id").limit(n))
