"""KPI aggregates (AGG-3..6, AGG-14/15).

Each KPI set is ONE aggregate pass with conditional counts (``count_if``)
instead of one filter + count per KPI. Money sums are DECIMAL, so totals are
exact and independent of partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def guarded_pct(num, den, places: int = 2) -> F.Column:
    """AGG-5: num / den * 100 rounded, 0.0 for an empty denominator."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.when(den > 0, F.round(num.cast("double") / den.cast("double") * 100, places)).otherwise(F.lit(0.0))


def final_metrics(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """AGG-6 / QRY-1: one row of KPIs from ONE aggregate pass.

    Decisions and outcomes are stacked into one narrow tagged stream (a union,
    no join) and reduced by a single global aggregate with conditional counts;
    partial aggregation runs in every map task."""
    d = decisions.select(F.lit(1).alias("__src"), F.col("action"))
    o = outcomes.select(F.lit(2).alias("__src"), "outcome", "amount", "recovered_amount")
    u = d.unionByName(o, allowMissingColumns=True)
    a, o_, src = F.col("action"), F.col("outcome"), F.col("__src")
    m = u.agg(
        F.count_if(src == 1).alias("records_evaluated"),
        F.count_if(src == 1).alias("policy_decisions"),
        F.count_if(a == "retry_now").alias("retry_now"),
        F.count_if(a == "retry_later").alias("retry_later"),
        F.count_if(a == "send_reminder").alias("send_reminder"),
        F.count_if(a == "escalate_human").alias("human_escalations"),
        F.count_if(src == 2).alias("recovery_attempts"),
        F.count_if(o_ == "recovered").alias("successful_recoveries"),
        F.count_if(o_ == "failed").alias("failed_recoveries"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("revenue_at_risk"),
        F.coalesce(F.sum("recovered_amount"), F.lit(0)).cast(MONEY).alias("revenue_recovered"),
    )
    return kpi_document(m)


def kpi_document(m: DataFrame) -> DataFrame:
    """The KPI row from its counts and sums."""
    return m.select(
        "records_evaluated", "policy_decisions", "retry_now", "retry_later", "send_reminder",
        "human_escalations", "recovery_attempts", "successful_recoveries", "failed_recoveries",
        guarded_pct("successful_recoveries", "recovery_attempts").alias("recovery_rate_percent"),
        "revenue_at_risk", "revenue_recovered",
        (F.col("revenue_at_risk") - F.col("revenue_recovered")).cast(MONEY).alias("revenue_unrecovered"),
        (F.col("failed_recoveries") + F.col("human_escalations")).alias("exception_count"),
        F.lit("synthetic").alias("evaluation_type"),
    )


def revenue_long(metrics: DataFrame) -> DataFrame:
    """AGG-14/15: wide KPI row -> (label, amount) rows + share of the at-risk total."""
    long = metrics.select(
        F.col("revenue_at_risk").alias("__total"),
        F.explode(F.array(
            F.struct(F.lit(1).alias("ord"), F.lit("Revenue at risk").alias("label"), F.col("revenue_at_risk").alias("amount")),
            F.struct(F.lit(2).alias("ord"), F.lit("Recovered").alias("label"), F.col("revenue_recovered").alias("amount")),
            F.struct(F.lit(3).alias("ord"), F.lit("Unrecovered").alias("label"), F.col("revenue_unrecovered").alias("amount")),
        )).alias("r"))
    return long.select(
        F.col("r.ord").alias("ord"), F.col("r.label").alias("label"), F.col("r.amount").cast(MONEY).alias("amount"),
        guarded_pct(F.col("r.amount"), F.col("__total")).alias("share_pct"))


def action_counts_long(metrics: DataFrame) -> DataFrame:
    """AGG-14: action KPIs as chart rows via stack()."""
    return metrics.selectExpr(
        "stack(4, 'Retry now', retry_now, 'Retry later', retry_later, "
        "'Send reminder', send_reminder, 'Human escalations', human_escalations) as (label, count)")
