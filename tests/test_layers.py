"""Layer invariants and edge inputs (empty tables, missing layers, sinks)."""
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dunning.operators import audit, execution, metrics, outcomes
from dunning.plans.layers import Layers
from dunning.sources import sinks
from dunning.sources.tables import SourceContractError, optional_table, require_columns


def test_empty_outcomes_give_zero_metrics(spark):
    dec = spark.createDataFrame([], "payment_id string, action string")
    out = spark.createDataFrame([], "payment_id string, action string, amount decimal(18,2), "
                                    "recovery_probability double, outcome string, recovered_amount decimal(18,2), "
                                    "reason string")
    r = metrics.final_metrics(dec, out).collect()[0]
    assert r.records_evaluated == 0 and r.recovery_rate_percent == 0.0 and r.revenue_at_risk == 0


def test_pipeline_invariants(spark):
    L = Layers(spark, SF_SMALL)
    n_failed = L.failed.count()
    assert L.decisions.count() == n_failed
    assert L.attempts.count() == n_failed
    acts = {r.action: r["count"] for r in L.decisions.groupBy("action").count().collect()}
    assert "request_new_payment_method" not in acts
    out = L.outcomes.agg(F.sum("amount").alias("a"), F.sum("recovered_amount").alias("r"),
                         F.count(F.lit(1)).alias("n")).collect()[0]
    assert out.n == acts.get("retry_now", 0)
    m = metrics.final_metrics(L.decisions, L.outcomes).collect()[0]
    assert m.revenue_at_risk == out.a and m.revenue_recovered == out.r
    assert sum(acts.values()) == m.policy_decisions


def test_routing_edge_rows(spark):
    dec = spark.createDataFrame([(" p1 ", "retry_now"), ("p2", "retry_now"), ("p3", "retry_now"),
                                 ("zz", "retry_now"), ("p1", "mystery"), ("p1", "escalate_human")],
                                "payment_id string, action string")
    pay = spark.createDataFrame([("p1", Decimal("10.00"), "c1"), ("p2", Decimal("0.00"), "c2"),
                                 ("p3", Decimal("0.004"), ""), ("p1", Decimal("99.00"), "c9")],
                                "payment_id string, amount decimal(18,3), customer_id string")
    pay = pay.withColumn("timestamp", F.when(F.col("amount") == 99, F.lit("2024-01-02")).otherwise(
        F.lit("2024-01-01")).cast("timestamp"))
    rows = execution.route(dec, pay).collect()
    by = [(r.payment_id, r.action_taken, r.execution_status, r.notes) for r in rows]
    assert ("p1", "retry_now", "sent") in [b[:3] for b in by]
    sent = [b for b in by if b[0] == "p1" and b[1] == "retry_now"][0]
    assert "amount=10.00" in sent[3]              # first payment row by time wins (T7)
    assert ("p2", "retry_now", "failed", "error=amount_not_positive:0.000") in by
    assert ("p3", "retry_now", "failed", execution.NOTE_ZERO_MINOR) in by
    assert ("zz", "retry_now", "failed", execution.NOTE_NOT_FOUND) in by
    assert ("p1", "mystery", "skipped", "error=action_unknown:mystery") in by
    tally = {r.execution_status: r["count"] for r in execution.tally(spark, execution.route(dec, pay)).collect()}
    assert tally == {"sent": 1, "failed": 3, "skipped": 2}


def test_missing_layers_give_typed_nulls(spark):
    failed = spark.createDataFrame([("p1", Decimal("5.00"), "non_retryable")],
                                   "payment_id string, amount decimal(18,2), root_cause_bucket string")
    a = audit.audit_table(failed, None, None)
    r = a.collect()[0]
    assert r.action is None and r.execution_status is None and r.recovered_amount == 0
    m = audit.audit_metrics(a).collect()[0]
    assert m.total_failed_events == 1 and m.total_events_with_decision == 0


def test_audit_fanout_vs_latest(spark):
    L = Layers(spark, SF_SMALL)
    all_ = audit.audit_table(L.failed, L.decisions, L.attempts_log)
    latest = audit.audit_table(L.failed, L.decisions, L.attempts_log, attempts_mode="latest")
    assert latest.count() == L.failed.count()
    assert all_.count() == L.failed.count() + L.decisions.filter("action = 'retry_now'").count()
    summ = audit.audit_summary(all_).collect()[0]
    assert sum(v.events for v in summ.by_root_cause.values()) == all_.count()
    import json
    keys = list(json.loads(audit.audit_summary(all_).select(F.to_json("by_action")).first()[0]))
    assert keys == sorted(summ.by_action)


def test_contracts_and_optional_tables(spark):
    df = spark.createDataFrame([("p",)], "payment_id string")
    try:
        require_columns(df, ["payment_id", "action"], "policy")
        raise AssertionError("expected a contract error")
    except SourceContractError as e:
        assert "action" in str(e)
    empty = optional_table(spark, "/nonexistent/path", execution.ATTEMPT_SCHEMA)
    assert empty.count() == 0 and empty.columns == execution.ATTEMPT_SCHEMA.fieldNames()


def test_sinks_roundtrip(spark):
    L = Layers(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="dunning-sink-")
    sinks.append_attempts(L.attempts, os.path.join(d, "log"), "a")
    sinks.append_attempts(L.attempts, os.path.join(d, "log"), "b")
    assert sinks.read_attempts(spark, os.path.join(d, "log")).count() == 2 * L.attempts.count()
    m = metrics.final_metrics(L.decisions, L.outcomes)
    sinks.write_metrics_json(m, os.path.join(d, "m"))
    doc = sinks.metrics_document(spark.read.json(os.path.join(d, "m")))
    assert doc["evaluation_type"] == "synthetic"
    nan = spark.createDataFrame([(float("nan"), "x")], "v double, s string")
    assert tuple(sinks.records_with_count(nan, os.path.join(d, "listing")).first()) == (1, '{"v":null,"s":"x"}')
    outs = outcomes.failed_outcomes(L.outcomes.withColumn("outcome", F.upper("outcome")))
    assert outs.count() == L.outcomes.filter("outcome = 'failed'").count()


def test_null_keys_and_frequency_order(spark):
    """T2: group summaries drop NULL keys, the client view counts them as
    'unknown'; T8: frequency table ordered by count desc, then key."""
    from dunning.operators import policy as pol
    dec = spark.createDataFrame([("a", "retry_now"), ("b", None), ("c", "escalate_human"),
                                 ("d", "escalate_human"), ("e", "retry_later"), ("f", None)],
                                "payment_id string, action string")
    summ = [(r.action, r["count"]) for r in pol.action_summary(dec).collect()]
    assert summ == [("escalate_human", 2), ("retry_later", 1), ("retry_now", 1)]
    labels = {r.action: (r["count"], r.label) for r in pol.action_labels(dec).collect()}
    assert labels["unknown"] == (2, "unknown") and labels["retry_now"] == (1, "retry now")
    aud = spark.createDataFrame([("x", None, None, Decimal("1.00")), ("y", "non_retryable", None, Decimal("2.00"))],
                                "payment_id string, root_cause_bucket string, execution_status string, "
                                "amount decimal(18,2)").withColumn("action", F.lit(None).cast("string"))
    assert [r.root_cause_bucket for r in audit.audit_by_cause(aud).collect()] == ["non_retryable"]
    assert audit.audit_by_action(aud).count() == 0
