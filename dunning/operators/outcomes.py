"""Recovery outcome labelling (DEC-7, JON-1, FN-8).

For each retry_now decision: amount from the payments table (left join),
recovery_probability = (first 8 hex digits of SHA-256(payment_id)) mod 100 / 100,
recovered when that value is below the threshold (a deterministic hold-out
assignment, not random sampling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.functions.expr import hash_fraction
from dunning.operators.rules import OutcomeParams

# Fixed texts of the outcome rows.
REASON_RECOVERED = "Synthetic recovery success"
REASON_FAILED = "Synthetic recovery unsuccessful"

OUTCOME_COLUMNS = ["payment_id", "action", "amount", "recovery_probability", "outcome",
                   "recovered_amount", "reason"]


def label_outcomes(decisions: DataFrame, payments: DataFrame, params: OutcomeParams | None = None) -> DataFrame:
    p = params or OutcomeParams()
    retries = decisions.filter(F.col("action") == "retry_now").select("payment_id", "action")
    j = retries.join(payments.select("payment_id", "amount"), "payment_id", "left")
    prob = hash_fraction("payment_id", 100)
    ok = prob < F.lit(p.threshold)
    return j.select(
        "payment_id", "action", "amount",
        F.round(prob, 4).alias("recovery_probability"),
        F.when(ok, F.lit("recovered")).otherwise(F.lit("failed")).alias("outcome"),
        F.when(ok, F.col("amount")).otherwise(F.lit(0)).cast(T.DecimalType(18, 2)).alias("recovered_amount"),
        F.when(ok, F.lit(REASON_RECOVERED)).otherwise(F.lit(REASON_FAILED)).alias("reason"),
    )


def failed_outcomes(outcomes: DataFrame) -> DataFrame:
    """QRY-3 / FLT-3: case-insensitive outcome == 'failed'."""
    return outcomes.filter(F.lower(F.col("outcome").cast("string")) == "failed")


def first_ids(df: DataFrame, n: int = 10, col: str = "payment_id") -> DataFrame:
    """SRT-4: the first n non-empty ids (ordered), e.g. for an exceptions card."""
    c = F.trim(F.col(col).cast("string"))
    return df.select(c.alias(col)).filter(c.isNotNull() & (c != "")).orderBy(col).limit(n)
