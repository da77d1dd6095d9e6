"""Policy gates on hand-made rows (every gate, including the high-value gate
that has no row in the reference's committed outputs) and the NaN trap."""
from decimal import Decimal

from pyspark.sql import types as T

from dunning.operators import policy
from dunning.operators.rules import PolicyParams

SCHEMA = T.StructType([
    T.StructField("payment_id", T.StringType()), T.StructField("predicted_bucket", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("attempt_count", T.IntegerType()),
])


def _decide(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.payment_id: r for r in policy.decide(spark, df, PolicyParams(**kw)).collect()}


def test_gates(spark):
    rows = [
        ("low", "abandoned_checkout", 0.377, Decimal("23113.37"), 0),
        ("edge", "retryable_with_delay", 0.549, Decimal("1462.73"), 0),
        ("human", "escalate_human", 0.763, Decimal("1252.08"), 0),
        ("big", "retryable_transient", 0.70, Decimal("25000.00"), 0),
        ("big_sure", "retryable_transient", 0.80, Decimal("25000.00"), 0),
        ("nonretry", "non_retryable", 0.90, Decimal("100.00"), 0),
        ("delay", "retryable_with_delay", 0.60, Decimal("100.00"), 0),
        ("remind", "abandoned_checkout", 0.95, Decimal("100.00"), 0),
        ("capped", "retryable_with_delay", 0.95, Decimal("100.00"), 2),
        ("unknown", "mystery_bucket", 0.95, Decimal("100.00"), 0),
    ]
    d = _decide(spark, rows)
    assert (d["low"].action, d["low"].escalate, d["low"].max_attempts_allowed) == ("escalate_human", True, 0)
    assert d["low"].reason_code == "low_confidence" and "0.38" in d["low"].reason
    assert d["edge"].reason_code == "low_confidence" and "0.55" in d["edge"].reason
    assert d["human"].action == "escalate_human" and d["human"].reason_code == "default"
    assert d["big"].reason_code == "high_value" and d["big"].max_attempts_allowed == 0
    assert d["big_sure"].action == "retry_now" and d["big_sure"].max_attempts_allowed == 3
    assert d["big_sure"].retry_at == "2024-06-01 00:30:00"
    # cap 0 -> always escalates; request_new_payment_method is unreachable (F4)
    assert d["nonretry"].action == "escalate_human" and d["nonretry"].reason_code == "attempt_cap"
    assert d["nonretry"].max_attempts_allowed == 0
    assert d["delay"].action == "retry_later" and d["delay"].retry_at == "2024-06-02 00:00:00"
    assert d["remind"].action == "send_reminder" and d["remind"].retry_at == "2024-06-01 02:00:00"
    assert d["capped"].action == "escalate_human" and d["capped"].attempt_number == 3
    assert d["capped"].max_attempts_allowed == 2 and "=2" in d["capped"].reason
    assert d["unknown"].action == "escalate_human" and d["unknown"].reason_code == "attempt_cap"
    assert d["human"].retry_at is None


def test_null_confidence_falls_through_like_pandas_nan(spark):
    # pandas: NaN < 0.55 is False, so a missing confidence passes gate 1 (T1)
    d = _decide(spark, [("nan", "retryable_transient", None, Decimal("10.00"), 0)])
    assert d["nan"].action == "retry_now"


def test_attempts_table_drives_the_cap(spark):
    preds = spark.createDataFrame([("p1", "retryable_transient", 0.9, Decimal("5.00"), None)], SCHEMA).drop(
        "attempt_count")
    att = spark.createDataFrame([("p1",), ("p1",), ("p1",)], "payment_id string")
    r = policy.decide(spark, preds, attempts=att).collect()[0]
    assert r.action == "escalate_human" and r.attempt_number == 4
