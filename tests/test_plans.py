"""Plan properties of every registered query of the reference's operators (scale regressions)."""
import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from dunning.plans import catalog
from tools.plan_text import live_plan

ML = {"diagnosis_scores", "feature_importance", "model_accuracy", "model_report", "model_confusion", "risk_scores"}
NAMES = sorted(n for n in catalog.QUERIES if n not in ML)
UNPARTITIONED_WINDOW_OK = {"class_weights"}      # a window over the k-row class table
MAX_SHA2 = 60                                     # the webhook plans carry ~40-50


def _partition_of(window_line: str) -> str:
    """'Window [exprs], [partition keys], [order keys]' -> partition keys ('' if none)."""
    m = re.search(r"\], \[([^\[\]]*)\], \[[^\[\]]*\]\s*$", window_line)
    return m.group(1).strip() if m else ""


@pytest.mark.parametrize("name", NAMES)
def test_plan_properties(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, f"{name}: {bad}"
    windows = [line for line in plan.split("\n") if re.search(r"\bWindow \[", line)]
    unpartitioned = [w for w in windows if not _partition_of(w)]
    if name in UNPARTITIONED_WINDOW_OK:
        assert len(unpartitioned) == 1
    else:
        assert not unpartitioned, f"{name}: window without PARTITION BY: {unpartitioned[0][:200]}"
    live = live_plan(plan)
    assert live.count("sha2(") <= MAX_SHA2, f"{name}: {live.count('sha2(')} sha2 calls"


def test_metrics_read_no_history_windows(spark):
    """The KPIs need ids, amounts, buckets and confidences: no window by customer."""
    for name in ("final_metrics", "policy_decisions"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "customer_fail_count" not in plan
