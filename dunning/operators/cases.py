"""Payment case records and rule-made case text (JON-6/7/10, QRY-6, PRJ-5).

The reference assembles one case per request by rescanning every layer's
file. Here the case table is built for ALL payments in one plan: the payments
universe LEFT JOIN decision, latest attempt and outcome, all on payment_id.
Every right side has at most one row per id, so nothing fans out, and the
chained joins share one hash partitioning of the big side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.functions.expr import fmt_inr, fmt_percent, ts_text
from dunning.operators.audit import latest_attempts
from dunning.operators.joins import override_join
from dunning.sources import lookup_index

SUCCEEDED_NOTE = "state=succeeded"
ABSENT = "-"  # a field without a value in a case text
RECOVERY_FIELDS = ["outcome", "recovered_amount", "reason"]


def recovery_fields(outcomes: DataFrame) -> DataFrame:
    """PRJ-5: outcome fields renamed with the recovery_ prefix."""
    return outcomes.select("payment_id", "recovery_probability",
                           *[F.col(c).alias("recovery_" + c) for c in RECOVERY_FIELDS])


def payment_cases(universe: DataFrame, decisions: DataFrame, attempts: DataFrame,
                  outcomes: DataFrame) -> DataFrame:
    """Fields of later layers override those of the same name; decisions belong to failed payments only."""
    case = override_join(universe, decisions, "payment_id")
    # a decision on a payment that succeeded is no part of its case
    decided = [c for c in decisions.columns if c not in universe.columns]
    case = case.withColumns({c: F.when(F.col("source") == "failed", F.col(c)) for c in decided})
    case = override_join(case, latest_attempts(attempts), "payment_id")
    case = override_join(case, recovery_fields(outcomes), "payment_id")
    return (case.withColumn("found", F.lit(True))
                .withColumn("note", F.when(F.col("source") == "succeeded", F.lit(SUCCEEDED_NOTE))))


def case_text(cases: DataFrame) -> DataFrame:
    """QRY-6 without the remote model: a grounded summary per payment plus
    the prompt-ready record of a failed case as JSON text."""
    pid = F.col("payment_id")

    def text(state: str, **fields) -> F.Column:
        parts = [F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(ABSENT))) for k, v in fields.items()]
        return F.concat_ws("; ", F.concat(F.lit("payment="), pid), F.lit(f"state={state}"), *parts)

    paid = {"amount": fmt_inr("amount"), "method": F.col("method")}
    succeeded = text("succeeded", **paid)
    failed = text("failed", **paid, error=F.col("error_code"), diagnosis=F.col("diagnosed_bucket"),
                  confidence=fmt_percent("confidence"), action=F.col("action"), execution=F.col("execution_status"),
                  recovery=F.col("recovery_outcome"))
    record = F.to_json(F.struct(
        pid.alias("payment_id"), F.col("customer_id"), F.col("amount").cast("string").alias("amount"),
        F.col("method"), F.col("error_code"), F.col("diagnosed_bucket"), F.col("confidence"),
        F.col("action"), F.col("reason"), F.col("execution_status"), F.col("recovery_outcome")),
        {"ignoreNullFields": "false"})
    return cases.select(
        "payment_id", F.col("found"),
        F.when(F.col("source") == "succeeded", succeeded).otherwise(failed).alias("explanation"),
        F.when(F.col("source") == "failed", record).alias("case_json"))


def lookup(spark: SparkSession, texts: DataFrame, ids: list[str]) -> DataFrame:
    """QRY-6 for a list of ids (each once): one row per id, ``found`` false and a text that
    says so where it is in neither payments table."""
    asked = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "payment_id string")
    absent = F.concat(F.lit("payment="), F.col("payment_id"), F.lit("; state=unknown"))
    return asked.join(texts, "payment_id", "left").select(
        "payment_id", F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("explanation", absent).alias("explanation"), "case_json")


def case_from_index(spark: SparkSession, cases_index: str, payment_id: str) -> DataFrame:
    """QRY-6 for one id from cases laid out by ``lookup_index.write_index``: one bucket is read, no layer
    is computed. An unknown id gives zero rows."""
    return lookup_index.find(spark, cases_index, "payment_id", payment_id)


def case_for_payment(spark: SparkSession, sf_dir: str, payment_id: str) -> DataFrame:
    """QRY-6 for one id (the API's lookup): the bulk case plan restricted to
    one key. The order-key filter is pushed into the orders scan, and the
    payment_id filter stands above the layers' own products, which a first call
    computes for all payments. An unknown id gives zero rows; ``lookup`` gives a
    row for it."""
    from dunning.plans.layers import Layers
    from dunning.sources import payments as P
    L = Layers.of(spark, sf_dir)
    one = P.payment_by_id(spark, sf_dir, payment_id)
    universe = P.payments_universe(P.failed_payments(one), P.successful_payments(one))
    return payment_cases(universe, L.decisions.filter(F.col("payment_id") == payment_id),
                         L.attempts_log.filter(F.col("payment_id") == payment_id),
                         L.outcomes.filter(F.col("payment_id") == payment_id))
