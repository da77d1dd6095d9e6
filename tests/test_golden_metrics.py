"""KPI definitions against the reference's published evaluation numbers
(fixed values: 75 decisions = 23 retry_now / 10 retry_later / 1 reminder /
41 human; 23 attempts, 12 recovered, 11 failed; 290,647.66 at risk,
153,605.40 recovered -> 137,042.26 unrecovered, 52.17 %, 52 exceptions)."""
from decimal import Decimal

from dunning.operators import metrics

ACTIONS = ["retry_now"] * 23 + ["retry_later"] * 10 + ["send_reminder"] + ["escalate_human"] * 41
AT_RISK = Decimal("290647.66")
RECOVERED = Decimal("153605.40")


def _amounts(total: Decimal, n: int) -> list[Decimal]:
    base = (total / n).quantize(Decimal("0.01"))
    out = [base] * (n - 1)
    return out + [total - sum(out)]


def test_published_kpis(spark):
    dec = spark.createDataFrame([(f"p{i}", a) for i, a in enumerate(ACTIONS)], "payment_id string, action string")
    rec_amt = _amounts(RECOVERED, 12)
    fail_amt = _amounts(AT_RISK - RECOVERED, 11)
    rows = [(f"p{i}", "retry_now", a, 0.1, "recovered", a, "x") for i, a in enumerate(rec_amt)]
    rows += [(f"p{12 + i}", "retry_now", a, 0.9, "failed", Decimal("0.00"), "x") for i, a in enumerate(fail_amt)]
    out = spark.createDataFrame(rows, "payment_id string, action string, amount decimal(18,2), "
                                      "recovery_probability double, outcome string, "
                                      "recovered_amount decimal(18,2), reason string")
    m = metrics.final_metrics(dec, out).collect()[0]
    assert (m.records_evaluated, m.policy_decisions) == (75, 75)
    assert (m.retry_now, m.retry_later, m.send_reminder, m.human_escalations) == (23, 10, 1, 41)
    assert (m.recovery_attempts, m.successful_recoveries, m.failed_recoveries) == (23, 12, 11)
    assert m.recovery_rate_percent == 52.17
    assert m.revenue_at_risk == AT_RISK and m.revenue_recovered == RECOVERED
    assert m.revenue_unrecovered == Decimal("137042.26")
    assert m.exception_count == 52
    assert m.evaluation_type == "synthetic"
