"""Audit trail and audit KPIs (JON-2, AGG-7..10, PRJ-3/4).

failed payments LEFT JOIN decisions LEFT JOIN attempts, one row per failed
payment and attempt. ``attempts="all"`` keeps every attempt (a payment run
twice appears twice and its amount is counted twice, like the reference);
``attempts="latest"`` keeps the newest attempt per payment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.operators.joins import latest_per_key, suffix_clashes
from dunning.operators.metrics import MONEY, guarded_pct
from dunning.sources.tables import with_typed_nulls

#: What the two optional layers add to an audit row, with or without a row or the layer itself.
DECISION_NULLS = T.StructType([
    T.StructField("diagnosed_bucket", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("final_bucket_used", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("reason_code", T.StringType()),
    T.StructField("attempt_number", T.IntegerType()), T.StructField("max_attempts_allowed", T.IntegerType()),
    T.StructField("escalate", T.BooleanType()), T.StructField("retry_at", T.StringType()),
])
ATTEMPT_NULLS = T.StructType([
    T.StructField("action_taken", T.StringType()), T.StructField("execution_status", T.StringType()),
    T.StructField("recovered_amount", T.DecimalType(18, 2)), T.StructField("notes", T.StringType()),
    T.StructField("execution_timestamp", T.StringType()),
])
SUCCESS_STATUSES = ("success",)
ATTEMPT_ORDER = ["execution_timestamp", "notes", "action_taken", "execution_status"]


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """WIN-5 / JON-6: newest attempt per payment (ties broken by the other columns)."""
    return latest_per_key(attempts, "payment_id", ATTEMPT_ORDER)


def audit_table(failed: DataFrame, decisions: DataFrame | None, attempts: DataFrame | None,
                attempts_mode: str = "all") -> DataFrame:
    """Absent layers (``None``) give the same columns as present ones, typed nulls; the recovered amount is then 0."""
    audit = failed
    if decisions is None:
        audit = with_typed_nulls(audit, DECISION_NULLS)
    else:
        audit = audit.join(suffix_clashes(audit, decisions, ["payment_id"], "_policy"), "payment_id", "left")
    if attempts is None:
        audit = with_typed_nulls(audit, ATTEMPT_NULLS).withColumn("recovered_amount", F.lit(0).cast(T.DecimalType(18, 2)))
    else:
        att = attempts if attempts_mode == "all" else latest_attempts(attempts)
        att = suffix_clashes(audit, att, ["payment_id"], "_exec")
        # 1:N join; a payment with many attempts must not pin one task
        audit = audit.join(att, "payment_id", "left")  # adaptive skew handling splits the left side
    return audit


def audit_metrics(audit: DataFrame, success_statuses=SUCCESS_STATUSES) -> DataFrame:
    """AGG-7: one pass over the audit table."""
    ok = F.col("execution_status").isin(*success_statuses)
    m = audit.agg(
        F.count(F.lit(1)).alias("total_failed_events"),
        F.count_if(F.col("action").isNotNull()).alias("total_events_with_decision"),
        F.count_if(F.col("execution_status").isNotNull()).alias("total_attempts_executed"),
        F.count_if(ok).alias("total_recovered_count"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("total_amount_at_risk"),
        F.coalesce(F.sum(F.when(ok, F.col("recovered_amount"))), F.lit(0)).cast(MONEY).alias("total_amount_recovered"),
    )
    return m.select(
        "total_failed_events", "total_events_with_decision", "total_attempts_executed", "total_recovered_count",
        guarded_pct("total_recovered_count", "total_attempts_executed").alias("recovery_rate_pct_of_executed"),
        "total_amount_at_risk", "total_amount_recovered",
        guarded_pct("total_amount_recovered", "total_amount_at_risk").alias("pct_of_at_risk_amount_recovered"))


def _group_summary(audit: DataFrame, key: str, success_statuses) -> DataFrame:
    ok = F.col("execution_status").isin(*success_statuses)
    return (audit.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("events"), F.count_if(ok).alias("recovered")))


def audit_by_cause(audit: DataFrame, success_statuses=SUCCESS_STATUSES) -> DataFrame:
    """AGG-8 (null keys dropped, like a pandas groupby)."""
    return _group_summary(audit, "root_cause_bucket", success_statuses)


def audit_by_action(audit: DataFrame, success_statuses=SUCCESS_STATUSES) -> DataFrame:
    """AGG-9."""
    return _group_summary(audit, "action", success_statuses)


def audit_summary(audit: DataFrame, success_statuses=SUCCESS_STATUSES) -> DataFrame:
    """Nested document: KPIs + by_root_cause + by_action maps, one row.

    ONE pass over the audit table: GROUPING SETS ((root_cause_bucket),
    (action), ()) computes the per-cause groups, the per-action groups and
    the global KPIs in a single Expand + aggregate; a second aggregate over
    those few rows folds them into the document."""
    ok = F.col("execution_status").isin(*success_statuses)
    g = audit.groupingSets(
        [["root_cause_bucket"], ["action"], []], "root_cause_bucket", "action"
    ).agg(
        F.grouping_id().alias("__gid"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(ok).alias("recovered"),
        F.count_if(F.col("action").isNotNull()).alias("total_events_with_decision"),
        F.count_if(F.col("execution_status").isNotNull()).alias("total_attempts_executed"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("total_amount_at_risk"),
        F.coalesce(F.sum(F.when(ok, F.col("recovered_amount"))), F.lit(0)).cast(MONEY).alias("total_amount_recovered"),
    )
    # grouping_id bits: (root_cause_bucket, action); 1 = rolled up
    by_cause = (F.col("__gid") == 1) & F.col("root_cause_bucket").isNotNull()
    by_action = (F.col("__gid") == 2) & F.col("action").isNotNull()
    glob = F.col("__gid") == 3

    def pick(c):
        return F.max(F.when(glob, F.col(c)))

    entry = lambda k: F.struct(F.col(k).alias("k"), F.struct("events", "recovered").alias("v"))
    doc = g.agg(
        pick("events").alias("total_failed_events"), pick("total_events_with_decision").alias("total_events_with_decision"),
        pick("total_attempts_executed").alias("total_attempts_executed"), pick("recovered").alias("total_recovered_count"),
        pick("total_amount_at_risk").alias("total_amount_at_risk"),
        pick("total_amount_recovered").alias("total_amount_recovered"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(by_cause, entry("root_cause_bucket"))))).alias("by_root_cause"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(by_action, entry("action"))))).alias("by_action"))
    return doc.select(
        "total_failed_events", "total_events_with_decision", "total_attempts_executed", "total_recovered_count",
        guarded_pct("total_recovered_count", "total_attempts_executed").alias("recovery_rate_pct_of_executed"),
        "total_amount_at_risk", "total_amount_recovered",
        guarded_pct("total_amount_recovered", "total_amount_at_risk").alias("pct_of_at_risk_amount_recovered"),
        "by_root_cause", "by_action")
