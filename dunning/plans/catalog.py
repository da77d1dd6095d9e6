"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables of that
directory in full; column names are identical on both sides.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.functions.expr import humanize, ts_text
from dunning.operators import audit as A
from dunning.operators import cases as C
from dunning.operators import diagnosis as D
from dunning.operators import evaluation as EV
from dunning.operators import execution, features, metrics, outcomes, policy
from dunning.operators import models as M
from dunning.operators.joins import first_per_key
from dunning.plans import oracle as O
from dunning.plans.layers import Layers
from dunning.sources import payments as P
from dunning.sources import lookup_index, sinks, tables
from dunning.session import ensure_checkpoint_dir
from dunning.streaming import dedupe, live_metrics, recovery_log
from dunning.streaming import webhook as W

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


PAYMENT_OUT = ["payment_id", "customer_id", "amount", "method", "timestamp", "status", "error_code",
               "error_reason", "error_description", "root_cause_bucket"]


def _payment_text(df: DataFrame, extra: tuple = ()) -> DataFrame:
    return df.select(*[ts_text("timestamp").alias("timestamp") if c == "timestamp" else F.col(c)
                       for c in PAYMENT_OUT], *extra)


_PAY_SQL = ", ".join(O.ts_text('"timestamp"') + ' AS "timestamp"' if c == "timestamp" else c for c in PAYMENT_OUT)


# --- sources / set ops -------------------------------------------------------
@register("payments_failed", O.with_ctes(O.cte_payments(), select=f"SELECT {_PAY_SQL} FROM failed"))
def payments_failed(spark, sf_dir):
    return _payment_text(Layers.of(spark, sf_dir).failed)


@register("payments_universe", O.with_ctes(O.cte_payments(), O.cte_universe(), select=f"""
SELECT {_PAY_SQL}, source FROM universe"""))
def payments_universe(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    u = P.payments_universe(L.failed, P.successful_payments_scan(spark, sf_dir))
    return _payment_text(u, ("source",))


# --- windows / features --------------------------------------------------------
@register("customer_fail_history", O.with_ctes(O.cte_payments(), O.cte_history(), select="""
SELECT payment_id, customer_id, customer_fail_count, hour_of_day, day_of_week FROM history"""))
def customer_fail_history(spark, sf_dir):
    h = features.customer_fail_history(Layers.of(spark, sf_dir).failed)
    return h.select("payment_id", "customer_id", "customer_fail_count", "hour_of_day", "day_of_week")


@register("customer_risk_features", O.with_ctes(O.cte_payments(), select="""
SELECT payment_id, customer_id, amount, method, hour_of_day, day_of_week,
       CASE WHEN txn > 0 THEN CAST(fails AS DOUBLE) / CAST(txn AS DOUBLE) ELSE 0.0 END
         AS customer_prior_fail_rate,
       txn AS customer_txn_count_so_far,
       CAST(status = 'failed' AS INTEGER) AS actual_at_risk
FROM (
  SELECT *,
    CAST(hour("timestamp") AS INTEGER) AS hour_of_day,
    CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
    count(*) OVER w AS txn,
    COALESCE(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER w, 0) AS fails
  FROM payments
  WINDOW w AS (PARTITION BY customer_id ORDER BY "timestamp", payment_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def customer_risk_features(spark, sf_dir):
    f = features.customer_risk_features(Layers.of(spark, sf_dir).payments)
    return f.select("payment_id", "customer_id", "amount", "method", "hour_of_day", "day_of_week",
                    "customer_prior_fail_rate", "customer_txn_count_so_far", "actual_at_risk")


# --- diagnosis / policy ----------------------------------------------------------
@register("diagnosis_predictions", O.with_ctes(O.cte_payments(), O.cte_history(), O.cte_predictions(),
                                               select="SELECT * FROM preds"))
def diagnosis_predictions(spark, sf_dir):
    return Layers.of(spark, sf_dir).predictions


_DEC = (O.cte_payments(), O.cte_history(), O.cte_predictions(), O.cte_decisions())


@register("policy_decisions", O.with_ctes(*_DEC, select="SELECT * FROM decisions"))
def policy_decisions(spark, sf_dir):
    return Layers.of(spark, sf_dir).decisions


_TRIES = "COALESCE((SELECT count(*) FROM lineitem l WHERE 'pay_' || CAST(l.l_orderkey AS VARCHAR) = preds.payment_id), 0)"


@register("policy_with_attempts", O.with_ctes(O.cte_payments(), O.cte_history(), O.cte_predictions(), O.cte_decisions(_TRIES),
                                              select="SELECT * FROM decisions"))
def policy_with_attempts(spark, sf_dir):
    """Gate 4 with attempts so far: one attempt per line item of the payment's order."""
    tries = tables.read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).select(
        F.concat(F.lit("pay_"), F.col("l_orderkey").cast("string")).alias("payment_id"))
    return policy.decide(spark, D.class_share_scores(Layers.of(spark, sf_dir).failed), attempts=tries)


@register("policy_action_titles", O.with_ctes(*_DEC, select="""
SELECT action, array_to_string(list_transform(string_split(replace(action, '_', ' '), ' '),
                                              lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title, count(*) AS count
FROM decisions WHERE action IS NOT NULL GROUP BY action"""))
def policy_action_titles(spark, sf_dir):
    return policy.action_summary(Layers.of(spark, sf_dir).decisions).select("action", humanize("action").alias("title"), "count")


@register("policy_action_summary", O.with_ctes(*_DEC, select="""
SELECT action, count(*) AS count FROM decisions WHERE action IS NOT NULL GROUP BY action"""))
def policy_action_summary(spark, sf_dir):
    return policy.action_summary(Layers.of(spark, sf_dir).decisions)


@register("policy_action_labels", O.with_ctes(*_DEC, select="""
SELECT action, count, replace(action, '_', ' ') AS label FROM (
  SELECT COALESCE(action, 'unknown') AS action, count(*) AS count FROM decisions
  GROUP BY COALESCE(action, 'unknown'))"""))
def policy_action_labels(spark, sf_dir):
    return policy.action_labels(Layers.of(spark, sf_dir).decisions)


@register("escalation_share", O.with_ctes(*_DEC, select="""
SELECT count(*) FILTER (WHERE escalate) AS escalated, count(*) AS decisions FROM decisions"""))
def escalation_share(spark, sf_dir):
    return policy.escalation_share(Layers.of(spark, sf_dir).decisions)


# --- execution -------------------------------------------------------------------
_ATT = (*_DEC, O.cte_attempts())


@register("execution_routing", O.with_ctes(*_ATT, select="SELECT * FROM attempts"))
def execution_routing(spark, sf_dir):
    return Layers.of(spark, sf_dir).attempts


@register("execution_tally", O.with_ctes(*_ATT, select="""
SELECT s.execution_status, COALESCE(c.n, 0) AS count
FROM (VALUES ('sent'), ('failed'), ('skipped')) s(execution_status)
LEFT JOIN (SELECT execution_status, count(*) AS n FROM attempts GROUP BY 1) c USING (execution_status)
UNION ALL
SELECT execution_status, count(*) AS count FROM attempts
WHERE execution_status NOT IN ('sent', 'failed', 'skipped') GROUP BY 1"""))
def execution_tally(spark, sf_dir):
    return execution.tally(spark, Layers.of(spark, sf_dir).attempts)


@register("retry_requests", O.with_ctes(*_ATT, select="""
SELECT a.payment_id,
       CAST(round(l.amount * 100) AS BIGINT) AS amount_minor,
       'INR' AS currency,
       'Recovery for failed payment ' || a.payment_id AS description,
       'recovery_' || a.payment_id AS reference_id,
       'plink_' || substr(sha256('link|' || a.payment_id), 1, 14) AS payment_link_id,
       CASE WHEN NULLIF(trim(l.customer_id), '') IS NOT NULL
            THEN CAST(json_object('original_payment_id', a.payment_id, 'customer_id', trim(l.customer_id)) AS VARCHAR)
            ELSE CAST(json_object('original_payment_id', a.payment_id) AS VARCHAR) END AS notes_json
FROM attempts a LEFT JOIN lookup l ON a.payment_id = l.payment_id
WHERE a.action_taken = 'retry_now' AND a.execution_status = 'sent'"""))
def retry_requests(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    return execution.retry_requests(L.attempts, L.failed)


# --- outcomes / metrics ----------------------------------------------------------------
_OUT = (*_DEC, O.cte_outcomes())


@register("recovery_outcomes", O.with_ctes(*_OUT, select="SELECT * FROM outcomes"))
def recovery_outcomes(spark, sf_dir):
    return Layers.of(spark, sf_dir).outcomes


@register("recovery_exceptions", O.with_ctes(*_OUT, select="""
SELECT * FROM outcomes WHERE lower(CAST(outcome AS VARCHAR)) = 'failed'"""))
def recovery_exceptions(spark, sf_dir):
    return outcomes.failed_outcomes(Layers.of(spark, sf_dir).outcomes)


@register("exceptions_listing", O.with_ctes(*_OUT, select="""
SELECT (SELECT count(*) FROM outcomes WHERE lower(outcome) = 'failed') AS count,
  CAST(json_object('payment_id', payment_id, 'action', action, 'outcome', outcome, 'reason', reason) AS VARCHAR) AS record
FROM outcomes WHERE lower(outcome) = 'failed'"""))
def exceptions_listing(spark, sf_dir):
    listed = outcomes.failed_outcomes(Layers.of(spark, sf_dir).outcomes).select("payment_id", "action", "outcome", "reason")
    return sinks.records_with_count(listed, _scratch(spark, "listing"))


_MET = (*_OUT, O.cte_metrics())


@register("final_metrics", O.with_ctes(*_MET, select="SELECT * FROM metrics"))
def final_metrics(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    return metrics.final_metrics(L.decisions, L.outcomes)


@register("final_metrics_live", O.with_ctes(*_MET, select="SELECT * FROM metrics"))
def final_metrics_live(spark, sf_dir):
    """AGG-6 kept up to date: decisions that count line items as attempts come first, then the decisions without attempts
    replace them; outcomes of payments that are no longer retried are withdrawn."""
    L = Layers.of(spark, sf_dir)
    first = policy_with_attempts(spark, sf_dir)
    first_outcomes = outcomes.label_outcomes(first, L.payments)
    gone = first_outcomes.select("payment_id").join(L.outcomes, "payment_id", "left_anti")
    folder = _scratch(spark, "metrics-live")
    steps = [[live_metrics.changes(first, live_metrics.DECISION, 1), live_metrics.changes(first_outcomes, live_metrics.OUTCOME, 1)],
             [live_metrics.changes(L.decisions, live_metrics.DECISION, 2), live_metrics.changes(L.outcomes, live_metrics.OUTCOME, 2),
              live_metrics.changes(gone, live_metrics.OUTCOME, 2, deleted=True)]]
    for parts in steps:
        for rows in parts:
            rows.write.mode("append").parquet(f"{folder}/feed")
        live_metrics.start(spark, f"{folder}/feed", f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return live_metrics.document(spark, f"{folder}/counts")


@register("revenue_long", O.with_ctes(*_MET, select="""
SELECT ord, label, amount,
       CASE WHEN revenue_at_risk > 0
            THEN round(CAST(amount AS DOUBLE) / CAST(revenue_at_risk AS DOUBLE) * 100, 2) ELSE 0.0 END AS share_pct
FROM (
  SELECT 1 AS ord, 'Revenue at risk' AS label, revenue_at_risk AS amount, revenue_at_risk FROM metrics
  UNION ALL SELECT 2, 'Recovered', revenue_recovered, revenue_at_risk FROM metrics
  UNION ALL SELECT 3, 'Unrecovered', revenue_unrecovered, revenue_at_risk FROM metrics)"""))
def revenue_long(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    return metrics.revenue_long(metrics.final_metrics(L.decisions, L.outcomes))


# --- attempts log: first / latest per payment (WIN-4/5, JON-6) ------------------------

_LOG = (*_DEC, O.cte_attempts_log())
_ATT_COLS = "payment_id, action_taken, execution_status, recovered_amount, notes, execution_timestamp"


@register("first_attempt", O.with_ctes(*_LOG, select=f"""
SELECT {_ATT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY execution_timestamp ASC NULLS FIRST,
                               notes ASC NULLS FIRST, action_taken ASC NULLS FIRST,
                               execution_status ASC NULLS FIRST) AS rn
  FROM attempts_log) WHERE rn = 1"""))
def first_attempt(spark, sf_dir):
    return first_per_key(Layers.of(spark, sf_dir).attempts_log, "payment_id", A.ATTEMPT_ORDER)


@register("latest_attempt", O.with_ctes(*_LOG, select="SELECT * FROM latest_attempt"))
def latest_attempt(spark, sf_dir):
    return A.latest_attempts(Layers.of(spark, sf_dir).attempts_log)


# --- audit (JON-2, AGG-7..10) -----------------------------------------------------------
_AUD = (*_LOG, """
audit AS (
  SELECT f.*, d.* EXCLUDE (payment_id), a.* EXCLUDE (payment_id)
  FROM failed f LEFT JOIN decisions d ON f.payment_id = d.payment_id
                LEFT JOIN attempts_log a ON f.payment_id = a.payment_id)""")


def _audit(spark, sf_dir, mode="all"):
    L = Layers.of(spark, sf_dir)
    return A.audit_table(L.failed, L.decisions, L.attempts_log, attempts_mode=mode)


@register("audit_table", O.with_ctes(*_AUD, select=f"""
SELECT * EXCLUDE ("timestamp"), {O.ts_text('"timestamp"')} AS "timestamp" FROM audit"""))
def audit_table(spark, sf_dir):
    return _audit(spark, sf_dir).withColumn("timestamp", ts_text("timestamp"))


_AUDIT_METRICS_SQL = """
SELECT total_failed_events, total_events_with_decision, total_attempts_executed, total_recovered_count,
       CASE WHEN total_attempts_executed > 0 THEN round(CAST(total_recovered_count AS DOUBLE)
            / CAST(total_attempts_executed AS DOUBLE) * 100, 2) ELSE 0.0 END AS recovery_rate_pct_of_executed,
       total_amount_at_risk, total_amount_recovered,
       CASE WHEN total_amount_at_risk > 0 THEN round(CAST(total_amount_recovered AS DOUBLE)
            / CAST(total_amount_at_risk AS DOUBLE) * 100, 2) ELSE 0.0 END AS pct_of_at_risk_amount_recovered
FROM (
  SELECT count(*) AS total_failed_events,
         count(*) FILTER (WHERE action IS NOT NULL) AS total_events_with_decision,
         count(*) FILTER (WHERE execution_status IS NOT NULL) AS total_attempts_executed,
         count(*) FILTER (WHERE execution_status IN ('success')) AS total_recovered_count,
         CAST(COALESCE(sum(amount), 0) AS DECIMAL(38,2)) AS total_amount_at_risk,
         CAST(COALESCE(sum(CASE WHEN execution_status IN ('success') THEN recovered_amount END), 0)
              AS DECIMAL(38,2)) AS total_amount_recovered
  FROM audit)"""


@register("audit_metrics", O.with_ctes(*_AUD, select=_AUDIT_METRICS_SQL))
def audit_metrics(spark, sf_dir):
    return A.audit_metrics(_audit(spark, sf_dir))


@register("audit_metrics_latest", O.with_ctes(*_LOG, """
audit AS (
  SELECT f.*, d.* EXCLUDE (payment_id), a.* EXCLUDE (payment_id)
  FROM failed f LEFT JOIN decisions d ON f.payment_id = d.payment_id
                LEFT JOIN latest_attempt a ON f.payment_id = a.payment_id)""", select=_AUDIT_METRICS_SQL))
def audit_metrics_latest(spark, sf_dir):
    return A.audit_metrics(_audit(spark, sf_dir, "latest"))


_GROUP_SQL = """
SELECT {k}, count(*) AS events, count(*) FILTER (WHERE execution_status IN ('success')) AS recovered
FROM audit WHERE {k} IS NOT NULL GROUP BY {k}"""


@register("audit_by_cause", O.with_ctes(*_AUD, select=_GROUP_SQL.format(k="root_cause_bucket")))
def audit_by_cause(spark, sf_dir):
    return A.audit_by_cause(_audit(spark, sf_dir))


@register("audit_by_action", O.with_ctes(*_AUD, select=_GROUP_SQL.format(k="action")))
def audit_by_action(spark, sf_dir):
    return A.audit_by_action(_audit(spark, sf_dir))


def _json_map_sql(k: str) -> str:
    return (f"(SELECT '{{' || string_agg('\"' || {k} || '\":{{\"events\":' || events || ',\"recovered\":' "
            f"|| recovered || '}}', ',' ORDER BY {k}) || '}}' FROM ({_GROUP_SQL.format(k=k)}))")


@register("audit_summary", O.with_ctes(*_AUD, select=f"""
SELECT m.*, {_json_map_sql('root_cause_bucket')} AS by_root_cause, {_json_map_sql('action')} AS by_action
FROM ({_AUDIT_METRICS_SQL}) m"""))
def audit_summary(spark, sf_dir):
    s = A.audit_summary(_audit(spark, sf_dir))
    return s.withColumn("by_root_cause", F.to_json("by_root_cause")).withColumn("by_action", F.to_json("by_action"))


# --- cases (JON-7/10, QRY-6) --------------------------------------------------------------
_CASE = (*_LOG, O.cte_outcomes(), O.cte_universe(), f"""
cases AS (
  SELECT u.*, d.* EXCLUDE (payment_id), a.* EXCLUDE (payment_id),
         o.recovery_probability, o.outcome AS recovery_outcome,
         o.recovered_amount AS recovery_recovered_amount, o.reason AS recovery_reason,
         true AS found,
         CASE WHEN u.source = 'succeeded' THEN {O.q(C.SUCCEEDED_NOTE)} END AS note
  FROM universe u LEFT JOIN decisions d ON u.payment_id = d.payment_id
                  LEFT JOIN latest_attempt a ON u.payment_id = a.payment_id
                  LEFT JOIN outcomes o ON u.payment_id = o.payment_id)""")


def _cases(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    return C.payment_cases(L.universe, L.decisions, L.attempts_log, L.outcomes)


@register("payment_cases", O.with_ctes(*_CASE, select=f"""
SELECT * EXCLUDE ("timestamp"), {O.ts_text('"timestamp"')} AS "timestamp" FROM cases"""))
def payment_cases(spark, sf_dir):
    return _cases(spark, sf_dir).withColumn("timestamp", ts_text("timestamp"))


_CASE_TEXT_SELECT = f"""
SELECT payment_id, found,
  'payment=' || payment_id || '; state=' || source || '; amount=' || {O.fmt_inr('amount')}
    || '; method=' || COALESCE(method, {O.q(C.ABSENT)})
    || CASE WHEN source = 'succeeded' THEN '' ELSE
       '; error=' || COALESCE(error_code, {O.q(C.ABSENT)}) || '; diagnosis=' || COALESCE(diagnosed_bucket, {O.q(C.ABSENT)})
    || '; confidence=' || {O.fmt_percent('confidence')} || '; action=' || COALESCE(action, {O.q(C.ABSENT)})
    || '; execution=' || COALESCE(execution_status, {O.q(C.ABSENT)})
    || '; recovery=' || COALESCE(recovery_outcome, {O.q(C.ABSENT)}) END AS explanation,
  CASE WHEN source = 'failed' THEN CAST(json_object(
    'payment_id', payment_id, 'customer_id', customer_id, 'amount', CAST(amount AS VARCHAR),
    'method', method, 'error_code', error_code, 'diagnosed_bucket', diagnosed_bucket,
    'confidence', confidence, 'action', action, 'reason', reason, 'execution_status', execution_status,
    'recovery_outcome', recovery_outcome) AS VARCHAR) END AS case_json
FROM cases"""


@register("case_text", O.with_ctes(*_CASE, select=_CASE_TEXT_SELECT))
def case_text(spark, sf_dir):
    return C.case_text(_cases(spark, sf_dir))


#: Ids that the registered lookup asks for; the last two are in no table.
LOOKUP_IDS = ["pay_1", "pay_2", "pay_3", "pay_4", "pay_5", "pay_6", "pay_7", "pay_32", "pay_-1", "none"]


@register("case_lookup", O.with_ctes(*_CASE, f"asked AS (SELECT unnest({O.list_lit(LOOKUP_IDS)}) AS payment_id)", select=f"""
SELECT a.payment_id, COALESCE(c.found, false) AS found,
  COALESCE(t.explanation, 'payment=' || a.payment_id || '; state=unknown') AS explanation, t.case_json
FROM asked a LEFT JOIN cases c ON a.payment_id = c.payment_id LEFT JOIN ({_CASE_TEXT_SELECT}) t ON a.payment_id = t.payment_id"""))
def case_lookup(spark, sf_dir):
    return C.lookup(spark, C.case_text(_cases(spark, sf_dir)), LOOKUP_IDS)



@register("case_lookup_indexed", ORACLE["case_lookup"])
def case_lookup_indexed(spark, sf_dir):
    """FLT-5: the case texts laid out by id, then the buckets of the asked ids alone."""
    folder = _scratch(spark, "case-index")
    lookup_index.write_index(C.case_text(_cases(spark, sf_dir)), folder, "payment_id")
    asked = spark.createDataFrame([(i,) for i in LOOKUP_IDS], "payment_id string")
    return C.lookup(spark, lookup_index.find_all(spark, folder, "payment_id", asked), LOOKUP_IDS)


# --- evaluation (EVL-1..4, AGG-13, ML-3) ------------------------------------------------------
_PRED = (O.cte_payments(), O.cte_history(), O.cte_predictions())


def _split_sql() -> str:
    """preds + split: the plain-SQL form (a window per class; fine for the oracle)."""
    h = O.h8(O.q(f'split|{EV.SPLIT_SEED}|') + ' || payment_id')
    return f"""(SELECT * EXCLUDE (__h), CASE WHEN row_number() OVER (PARTITION BY actual_bucket ORDER BY __h, payment_id) - 1
                 < (count(*) OVER (PARTITION BY actual_bucket) * {EV.TEST_PERCENT} + 99) // 100
               THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, {h} AS __h FROM preds))"""


#: Evaluated are the rows of the test split, which the shares were not counted on.
_HELD = (*_PRED, f"held AS (SELECT * EXCLUDE (split) FROM {_split_sql()} WHERE split = 'test')")


@register("eval_accuracy", O.with_ctes(*_HELD, select="""
SELECT n, correct, CASE WHEN n > 0 THEN round(CAST(correct AS DOUBLE) / CAST(n AS DOUBLE), 6) ELSE 0.0 END AS accuracy
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE actual_bucket = predicted_bucket) AS correct FROM held)"""))
def eval_accuracy(spark, sf_dir):
    return EV.accuracy(Layers.of(spark, sf_dir).held_out)


@register("eval_report", O.with_ctes(*_HELD, """
pc AS (SELECT actual_bucket AS actual, predicted_bucket AS predicted, count(*) AS n FROM held GROUP BY 1, 2),
labels AS (SELECT actual AS label FROM pc WHERE actual IS NOT NULL UNION SELECT predicted FROM pc WHERE predicted IS NOT NULL),
per0 AS (
  SELECT l.label,
         COALESCE((SELECT sum(n) FROM pc WHERE actual = l.label AND predicted = l.label), 0) AS tp,
         COALESCE((SELECT sum(n) FROM pc WHERE actual = l.label), 0) AS support,
         COALESCE((SELECT sum(n) FROM pc WHERE predicted = l.label), 0) AS predicted_n
  FROM labels l),
per1 AS (
  SELECT label, support,
         CASE WHEN predicted_n > 0 THEN CAST(tp AS DOUBLE) / CAST(predicted_n AS DOUBLE) ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) ELSE 0.0 END AS recall
  FROM per0),
per AS (
  SELECT label, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         CAST(support AS BIGINT) AS support
  FROM per1),
agg AS (
  SELECT sum(precision) / count(*) AS mp, sum(recall) / count(*) AS mr, sum(f1) / count(*) AS mf,
         sum(support) AS s, sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf
  FROM per)""", select="""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM per
UNION ALL
SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(s AS BIGINT) FROM agg
UNION ALL
SELECT 'weighted avg', round(CASE WHEN s > 0 THEN wp / s ELSE 0.0 END, 6),
       round(CASE WHEN s > 0 THEN wr / s ELSE 0.0 END, 6), round(CASE WHEN s > 0 THEN wf / s ELSE 0.0 END, 6),
       CAST(s AS BIGINT) FROM agg"""))
def eval_report(spark, sf_dir):
    return EV.classification_report(Layers.of(spark, sf_dir).held_out)


def _confusion_sql() -> str:
    labels = sorted(O.R.BUCKETS)
    cols = ", ".join(f"CAST(COALESCE(sum(n) FILTER (WHERE predicted = {O.q(x)}), 0) AS BIGINT) AS {x}"
                     for x in labels)
    dim = " UNION ALL ".join(f"SELECT {O.q(x)} AS actual" for x in labels)
    return f"""
SELECT d.actual, {", ".join(f"COALESCE(w.{x}, 0) AS {x}" for x in labels)}
FROM ({dim}) d LEFT JOIN (
  SELECT actual, {cols} FROM (
    SELECT actual_bucket AS actual, predicted_bucket AS predicted, count(*) AS n FROM held GROUP BY 1, 2)
  GROUP BY actual) w ON d.actual = w.actual"""


@register("eval_confusion", O.with_ctes(*_HELD, select=_confusion_sql()))
def eval_confusion(spark, sf_dir):
    return EV.confusion_matrix(spark, Layers.of(spark, sf_dir).held_out)


_RISK_SQL = O.with_ctes(O.cte_payments(), """
feat AS (
  SELECT payment_id, status, CAST(fails + 1 AS DOUBLE) / CAST(txn + 2 AS DOUBLE) AS risk_score
  FROM (
    SELECT *, count(*) OVER w AS txn,
      COALESCE(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER w, 0) AS fails
    FROM payments
    WINDOW w AS (PARTITION BY customer_id ORDER BY "timestamp", payment_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
risk AS (
  SELECT payment_id, CAST(status = 'failed' AS INTEGER) AS actual_at_risk, risk_score FROM feat),
scored AS (SELECT *, CAST(risk_score >= 0.5 AS INTEGER) AS flagged_at_risk FROM risk)""", select="{select}")


def _risk(spark, sf_dir):
    f = features.customer_risk_features(Layers.of(spark, sf_dir).payments)
    return EV.smoothed_risk_scores(f)


@register("detection_scores", _RISK_SQL.format(select="SELECT * FROM scored"))
def detection_scores(spark, sf_dir):
    return _risk(spark, sf_dir).select("payment_id", "actual_at_risk", "risk_score", "flagged_at_risk")


@register("detection_confusion", _RISK_SQL.format(select="""
SELECT tn, fp, fn, tp,
  round(CASE WHEN tn + fp + fn + tp > 0 THEN CAST(tn + tp AS DOUBLE) / CAST(tn + fp + fn + tp AS DOUBLE) ELSE 0.0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END, 6) AS recall
FROM (SELECT count(*) FILTER (WHERE actual_at_risk <> 1 AND flagged_at_risk <> 1) AS tn,
             count(*) FILTER (WHERE actual_at_risk <> 1 AND flagged_at_risk = 1) AS fp,
             count(*) FILTER (WHERE actual_at_risk = 1 AND flagged_at_risk <> 1) AS fn,
             count(*) FILTER (WHERE actual_at_risk = 1 AND flagged_at_risk = 1) AS tp FROM scored)"""))
def detection_confusion(spark, sf_dir):
    return EV.binary_confusion(_risk(spark, sf_dir))


@register("stratified_split", O.with_ctes(*_PRED, select=f"""
SELECT actual_bucket AS label, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test
FROM {_split_sql()} GROUP BY actual_bucket"""))
def stratified_split(spark, sf_dir):
    return EV.split_summary(Layers.of(spark, sf_dir).predictions)


@register("class_weights", O.with_ctes(*_PRED, select=f"""
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
FROM (SELECT actual_bucket AS label, count(*) AS n_c
      FROM {_split_sql()} WHERE split = 'train' GROUP BY actual_bucket)"""))
def class_weights(spark, sf_dir):
    p = Layers.of(spark, sf_dir).predictions
    return EV.class_weights(EV.with_split(p).filter(F.col("split") == "train"))


# --- webhook consumer (STR-1..6, JON-8/9, FN-9/10/20) -----------------------------------------


def _classified(spark, sf_dir):
    return Layers.of(spark, sf_dir).classified


@register("webhook_envelopes", O.with_ctes(O.cte_webhook(), select=f"""
SELECT delivery_id, {O.ts_text('received_at')} AS received_at, event_id, signature, body FROM envelopes"""))
def webhook_envelopes(spark, sf_dir):
    e = Layers.of(spark, sf_dir).envelopes
    return e.withColumn("received_at", ts_text("received_at"))


@register("webhook_status", O.with_ctes(O.cte_webhook(), select="""
SELECT status, count(*) AS count FROM classified GROUP BY status"""))
def webhook_status(spark, sf_dir):
    return W.status_counts(_classified(spark, sf_dir))


@register("webhook_recoveries", O.with_ctes(O.cte_webhook(), select="SELECT * FROM recovered"))
def webhook_recoveries(spark, sf_dir):
    return W.recoveries(_classified(spark, sf_dir))


_STATUS_SQL = O.with_ctes(O.cte_webhook(), select="SELECT delivery_id, event_id, event, status, amount FROM classified")


@register("webhook_stream_status", _STATUS_SQL)
def webhook_stream_status(spark, sf_dir):
    """STR-3: the deliveries land as JSON files, a stream with expiring state reports each of them."""
    folder = _scratch(spark, "webhook-stream")
    W.write_landing(Layers.of(spark, sf_dir).envelopes, f"{folder}/landing")
    stream = dedupe.start_bounded_stream(spark, f"{folder}/landing", f"{folder}/results", f"{folder}/checkpoint", W.TEST_SECRET)
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/results").select("delivery_id", "event_id", "event", "status", "amount")


@register("webhook_log_status", _STATUS_SQL)
def webhook_log_status(spark, sf_dir):
    """JON-8: the deliveries arrive in two parts, the second one is looked up in the log that the first one left."""
    folder = _scratch(spark, "webhook-log")
    guarded = Layers.of(spark, sf_dir).guarded
    middle = guarded.agg(F.percentile_approx(F.unix_micros("received_at"), 0.5, 1000).alias("m")).first()["m"]
    early = F.coalesce(F.unix_micros("received_at") < F.lit(middle), F.lit(True))
    for epoch, part in enumerate((guarded.where(early), guarded.where(~early))):
        seen = recovery_log.processed_ids(spark, f"{folder}/log", part)
        W.classify_guarded(part, seen).write.parquet(f"{folder}/results/epoch={epoch}")
        recovery_log.write_epoch(W.recoveries(spark.read.parquet(f"{folder}/results/epoch={epoch}")), f"{folder}/log", "batch", epoch)
    return spark.read.parquet(f"{folder}/results").select("delivery_id", "event_id", "event", "status", "amount")


@register("webhook_match", O.with_ctes(*_LOG, O.cte_webhook(), """
links AS (
  SELECT link_id, payment_id, execution_timestamp FROM (
    SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY execution_timestamp ASC NULLS FIRST,
                                 notes ASC NULLS FIRST, action_taken ASC NULLS FIRST,
                                 execution_status ASC NULLS FIRST) AS rn
    FROM (SELECT *, regexp_extract(notes, 'payment_link_id=([^;]+)', 1) AS link_id FROM attempts_log)
    WHERE link_id <> '') WHERE rn = 1)""", select="""
SELECT r.*, l.payment_id AS matched_payment_id, l.execution_timestamp AS matched_execution_timestamp,
       l.payment_id IS NOT NULL AS matched
FROM recovered r LEFT JOIN links l ON r.payment_link_id = l.link_id"""))
def webhook_match(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    rec = W.recoveries(_classified(spark, sf_dir))
    return W.match_recoveries(rec, L.attempts_log)


@register("webhook_match_contained", O.with_ctes(*_LOG, O.cte_webhook(), """
texts AS (SELECT DISTINCT notes FROM attempts_log WHERE notes IS NOT NULL),
ids AS (SELECT DISTINCT payment_link_id FROM recovered WHERE payment_link_id <> ''),
hits AS (SELECT payment_link_id, notes FROM ids JOIN texts ON contains(notes, payment_link_id)),
ranked AS (
  SELECT h.payment_link_id, a.payment_id, a.execution_timestamp,
    row_number() OVER (PARTITION BY h.payment_link_id ORDER BY a.execution_timestamp ASC NULLS FIRST, a.notes ASC NULLS FIRST,
                       a.action_taken ASC NULLS FIRST, a.execution_status ASC NULLS FIRST, a.payment_id ASC NULLS FIRST) AS rn
  FROM hits h JOIN attempts_log a ON a.notes = h.notes)""", select="""
SELECT r.*, k.payment_id AS matched_payment_id, k.execution_timestamp AS matched_execution_timestamp, k.rn IS NOT NULL AS matched
FROM recovered r LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) k ON r.payment_link_id = k.payment_link_id"""))
def webhook_match_contained(spark, sf_dir):
    return W.match_by_containment(W.recoveries(_classified(spark, sf_dir)), Layers.of(spark, sf_dir).attempts_log)


# --- Spark ML (ML-4..10): rows-only checks (no SQL oracle for a fitted model) ---------------


def _diag_features(spark, sf_dir):
    return D.diagnosis_features(Layers.of(spark, sf_dir).failed)


@register("diagnosis_scores")
def diagnosis_scores(spark, sf_dir):
    return Layers.of(spark, sf_dir).diagnosis_scores


@register("feature_importance")
def feature_importance(spark, sf_dir):
    fitted, _ = Layers.of(spark, sf_dir).diagnosis_fit
    return M.importance_frame(spark, M.feature_importance(fitted, 10))


@register("model_accuracy")
def model_accuracy(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    forest = EV.accuracy(L.diagnosis_scores).withColumn("model", F.lit("forest"))
    fitted, test = L.baseline_fit
    logistic = EV.accuracy(M.score_diagnosis(fitted, test)).withColumn("model", F.lit("logistic"))
    return forest.unionByName(logistic)


@register("model_report")
def model_report(spark, sf_dir):
    """EVL-2 on the forest's held-out predictions."""
    return EV.classification_report(Layers.of(spark, sf_dir).diagnosis_scores)


@register("model_confusion")
def model_confusion(spark, sf_dir):
    """EVL-3 on the forest's held-out predictions."""
    return EV.confusion_matrix(spark, Layers.of(spark, sf_dir).diagnosis_scores)


@register("risk_scores")
def risk_scores(spark, sf_dir):
    """ML-10: every payment, scored out of fold."""
    return Layers.of(spark, sf_dir).risk_scores


@register("cross_fit_folds", O.with_ctes(O.cte_payments(), select=f"""
SELECT payment_id, CAST(status = 'failed' AS INTEGER) AS actual_at_risk,
  CAST({O.h8(O.q(f'fold|{M.SEED}|') + ' || payment_id')} % {M.FOLDS} AS INTEGER) AS fold, true AS scored FROM payments"""))
def cross_fit_folds(spark, sf_dir):
    """ML-10: the fold whose model left out each payment, and that it has a score from 0 to 1 and a flag that follows it."""
    s = Layers.of(spark, sf_dir).risk_scores
    ok = F.col("risk_score").between(0, 1) & (F.col("flagged_at_risk") == (F.col("risk_score") >= EV.RISK_FLAG_THRESHOLD).cast("int"))
    return s.select("payment_id", "actual_at_risk", "fold", ok.alias("scored"))


@register("cross_fit_diagnosis", O.with_ctes(O.cte_payments(), select=f"""
SELECT payment_id, root_cause_bucket AS actual_bucket, CAST({O.h8(O.q(f'fold|{M.SEED}|') + ' || payment_id')} % {M.FOLDS} AS INTEGER) AS fold, true AS scored FROM failed"""))
def cross_fit_diagnosis(spark, sf_dir):
    """ML-7: every failed payment has a bucket and a confidence from a forest that did not see it."""
    s = Layers.of(spark, sf_dir).cross_scores
    ok = F.col("predicted_bucket").isin(*O.R.BUCKETS) & (F.col("confidence") > 0) & (F.col("confidence") <= 1)
    return s.select("payment_id", "actual_bucket", "fold", ok.alias("scored"))


# --- previews / top-k reports (SRT-3/4/5) -------------------------------------------------------
@register("policy_preview", O.with_ctes(*_DEC, select="""
SELECT payment_id, diagnosed_bucket, confidence, action, reason FROM decisions ORDER BY payment_id LIMIT 8"""))
def policy_preview(spark, sf_dir):
    return policy.decision_preview(Layers.of(spark, sf_dir).decisions, 8)


@register("exception_ids", O.with_ctes(*_OUT, select="""
SELECT trim(CAST(payment_id AS VARCHAR)) AS payment_id FROM outcomes
WHERE lower(CAST(outcome AS VARCHAR)) = 'failed' AND trim(CAST(payment_id AS VARCHAR)) <> ''
ORDER BY 1 LIMIT 10"""))
def exception_ids(spark, sf_dir):
    return outcomes.first_ids(outcomes.failed_outcomes(Layers.of(spark, sf_dir).outcomes), 10)


@register("eval_labels", O.with_ctes(*_PRED, select="""
SELECT DISTINCT actual_bucket AS label FROM preds WHERE actual_bucket IS NOT NULL"""))
def eval_labels(spark, sf_dir):
    return EV.sorted_labels(Layers.of(spark, sf_dir).predictions)


@register("action_counts_long", O.with_ctes(*_MET, select="""
SELECT 'Retry now' AS label, retry_now AS count FROM metrics
UNION ALL SELECT 'Retry later', retry_later FROM metrics
UNION ALL SELECT 'Send reminder', send_reminder FROM metrics
UNION ALL SELECT 'Human escalations', human_escalations FROM metrics"""))
def action_counts_long(spark, sf_dir):
    L = Layers.of(spark, sf_dir)
    return metrics.action_counts_long(metrics.final_metrics(L.decisions, L.outcomes))


@register("first_per_payment", O.with_ctes(O.cte_payments(), O.cte_lookup(), select="""
SELECT payment_id, amount, customer_id FROM lookup"""))
def first_per_payment(spark, sf_dir):
    """WIN-4 / JON-3 lookup side: first payment row per id (by time, then amount, customer)."""
    return execution.payment_lookup(Layers.of(spark, sf_dir).payments).drop("__found")


# --- products written and read again (SRC-1..3, SRC-5, SNK-1, SNK-4, SNK-5, FN-1, FN-15) -------------
@register("payments_csv", O.with_ctes(O.cte_payments(), select=f"SELECT {_PAY_SQL} FROM payments"))
def payments_csv(spark, sf_dir):
    """SRC-1, SNK-1: all payments as a headed CSV, typed again while it is read (FN-1)."""
    folder = _scratch(spark, "payments-csv")
    sinks.write_table(Layers.of(spark, sf_dir).payments.select(*PAYMENT_OUT), folder, fmt="csv")
    return _payment_text(P.payments_from_csv(spark, folder))


@register("decisions_csv", O.with_ctes(*_DEC, select="SELECT * FROM decisions"))
def decisions_csv(spark, sf_dir):
    """SRC-2, SNK-1: the decisions as a headed CSV, read with their declared schema."""
    folder = _scratch(spark, "decisions-csv")
    decisions = Layers.of(spark, sf_dir).decisions
    sinks.write_table(decisions, folder, fmt="csv")
    return tables.read_result(spark, folder, decisions.schema, "csv")


@register("final_metrics_json", O.with_ctes(*_MET, select="SELECT * FROM metrics"))
def final_metrics_json(spark, sf_dir):
    """SNK-4, SRC-5: the metrics document as one JSON file, read with its declared schema."""
    folder = _scratch(spark, "metrics-json")
    document = final_metrics(spark, sf_dir)
    sinks.write_metrics_json(document, folder)
    return sinks.read_metrics_json(spark, folder, document.schema)


@register("odds_listing", O.with_ctes(O.cte_payments(), """
odds AS (
  SELECT customer_id, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status <> 'failed') AS paid
  FROM payments GROUP BY customer_id)""", select="""
SELECT (SELECT count(*) FROM odds) AS count, CAST(json_object('customer_id', customer_id, 'failed', failed, 'paid', paid,
  'odds', CASE WHEN paid > 0 THEN round(CAST(failed AS DOUBLE) / paid, 6) END) AS VARCHAR) AS record FROM odds"""))
def odds_listing(spark, sf_dir):
    """SNK-5, FN-15: odds of customers that never paid are infinite, and null in the listing."""
    return sinks.records_with_count(features.customer_odds(Layers.of(spark, sf_dir).payments), _scratch(spark, "odds"))


_NULL_LAYERS = ", ".join(f"CAST({v} AS {t}) AS {c}" for c, t, v in [
    *[(f.name, {"string": "VARCHAR", "int": "INTEGER"}.get(f.dataType.simpleString(), f.dataType.simpleString()), "NULL")
      for f in A.DECISION_NULLS.fields],
    *[(f.name, "VARCHAR", "NULL") for f in A.ATTEMPT_NULLS.fields if f.name != "recovered_amount"],
    ("recovered_amount", "DECIMAL(18,2)", "0")])


@register("audit_without_layers", O.with_ctes(O.cte_payments(), select=f"SELECT {_PAY_SQL}, {_NULL_LAYERS} FROM failed"))
def audit_without_layers(spark, sf_dir):
    """SRC-3, PRJ-3: neither decisions nor attempts exist; the audit has the columns that it has with them."""
    audit = A.audit_table(Layers.of(spark, sf_dir).failed, None, None)
    return audit.withColumn("timestamp", ts_text("timestamp"))


@register("audit_with_clashes", O.with_ctes(*_LOG, select=f"""
SELECT f.* EXCLUDE ("timestamp"), {O.ts_text('f."timestamp"')} AS "timestamp", d.* EXCLUDE (payment_id),
  ld.amount AS amount_policy, a.* EXCLUDE (payment_id), CASE WHEN a.payment_id IS NOT NULL THEN ld.amount END AS amount_exec
FROM failed f LEFT JOIN decisions d ON f.payment_id = d.payment_id
LEFT JOIN lookup ld ON d.payment_id = ld.payment_id LEFT JOIN attempts_log a ON f.payment_id = a.payment_id"""))
def audit_with_clashes(spark, sf_dir):
    """PRJ-4: decisions and attempts carry an amount of their own, which keeps its layer's suffix."""
    L = Layers.of(spark, sf_dir)
    decided = execution.amounts_with_default(L.decisions, L.failed)
    tried = execution.amounts_with_default(L.attempts_log, L.failed)
    return A.audit_table(L.failed, decided, tried).withColumn("timestamp", ts_text("timestamp"))


@register("reference_amounts", O.with_ctes(O.cte_payments(), O.cte_lookup("failed"), O.cte_webhook(), select="""
SELECT r.event_id, r.payment_id, COALESCE(l.amount, CAST(0 AS DECIMAL(18,2))) AS amount
FROM (SELECT event_id, replace(reference_id, 'recovery_', '') AS payment_id FROM recovered) r
LEFT JOIN lookup l ON r.payment_id = l.payment_id"""))
def reference_amounts(spark, sf_dir):
    """JON-4: amount of the failed payment that a recovery refers to, 0 where it is none."""
    L = Layers.of(spark, sf_dir)
    asked = W.recoveries(_classified(spark, sf_dir)).select("event_id", F.replace("reference_id", F.lit("recovery_"), F.lit("")).alias("payment_id"))
    return execution.amounts_with_default(asked, L.failed)


@register("activity_records", O.with_ctes(*_OUT, O.cte_attempts(), select="""
SELECT 'decision' AS kind, * FROM decisions
UNION ALL BY NAME SELECT 'attempt' AS kind, * FROM attempts
UNION ALL BY NAME SELECT 'outcome' AS kind, * FROM outcomes"""))
def activity_records(spark, sf_dir):
    """SET-2: decisions, attempts and outcomes in one table with the columns of all three."""
    L = Layers.of(spark, sf_dir)
    parts = {"decision": L.decisions, "attempt": L.attempts, "outcome": L.outcomes}
    return tables.union_all_columns(*[rows.withColumn("kind", F.lit(kind)) for kind, rows in parts.items()])


# --- the webhook consumer as streams (SRC-6, SNK-3, STR-4, STR-5) -------------------------------------
@register("webhook_recovery_stream", O.with_ctes(O.cte_webhook(), select="SELECT * EXCLUDE (recovered_at) FROM recovered"))
def webhook_recovery_stream(spark, sf_dir):
    """SRC-6, SNK-3, STR-5: deliveries land as JSON files, a stream that remembers event ids appends each recovery once.
    (Of deliveries with one event id in one batch any may be the kept one, so its time is not returned.)"""
    folder = _scratch(spark, "recovery-stream")
    W.write_landing(Layers.of(spark, sf_dir).envelopes, f"{folder}/landing")
    W.start_recovery_log_stream(spark, f"{folder}/landing", f"{folder}/log", f"{folder}/checkpoint", W.TEST_SECRET).awaitTermination()
    return spark.read.parquet(f"{folder}/log").drop("recovered_at")


@register("webhook_stream_match", ORACLE["webhook_match"])
def webhook_stream_match(spark, sf_dir):
    """STR-4 over the stream: each batch's recoveries are matched to the attempts as they arrive."""
    folder = _scratch(spark, "match-stream")
    L = Layers.of(spark, sf_dir)
    W.write_landing(L.envelopes, f"{folder}/landing")
    W.start_stream(spark, f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", W.TEST_SECRET,
                   attempts=L.attempts_log).awaitTermination()
    return spark.read.parquet(f"{folder}/out/matches").drop("run", "epoch")


# --- what SQL can say of a fitted model (ML-4..9, SRT-2, FN-22) -----------------------------------------
_CATEGORY_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{c}_' || {c} AS feature FROM train WHERE {c} IS NOT NULL" for c in M.CATEGORICAL)
_NUMBER_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in M.NUMERIC)


@register("encoded_features", O.with_ctes(*_PRED, f"seen AS ({_CATEGORY_SQL})", select=f"""
SELECT payment_id, concat_ws(',', {", ".join(f"(SELECT feature FROM seen WHERE feature = '{c}_' || p.{c})" for c in M.CATEGORICAL)}) AS active,
  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in M.NUMERIC)} FROM preds p"""))
def encoded_features(spark, sf_dir):
    """ML-4: every failed payment as the models see it, by an encoder of the train split."""
    rows = _diag_features(spark, sf_dir)
    train, _ = M.split(rows)
    return M.encoded(M.fit_encoder(train), rows)


@register("importance_names", O.with_ctes(*_PRED, select=f"SELECT feature, true AS ordered FROM ({_CATEGORY_SQL} UNION ALL {_NUMBER_SQL})"))
def importance_names(spark, sf_dir):
    """ML-8, SRT-2: all features of the forest by name; importances are shares of 1 and fall along the listing."""
    pairs = M.feature_importance(Layers.of(spark, sf_dir).diagnosis_fit[0], None)
    values = [v for _, v in pairs]
    ordered = values == sorted(values, reverse=True) and min(values) >= 0 and abs(sum(values) - 1) < 1e-6
    return M.importance_frame(spark, pairs).select("feature", F.lit(ordered).alias("ordered"))


@register("model_holdout", O.with_ctes(*_HELD, select="""
SELECT model, payment_id, actual_bucket, true AS scored FROM held, (VALUES ('forest'), ('logistic')) m(model)
WHERE actual_bucket IS NOT NULL"""))
def model_holdout(spark, sf_dir):
    """ML-5..7, ML-9, FN-22: the forest, saved and loaded, and the baseline score exactly the held-out payments: each with a
    known bucket and a confidence above 0; the loaded forest says what the fitted one said."""
    L = Layers.of(spark, sf_dir)
    fitted, test = L.diagnosis_fit
    folder = _scratch(spark, "forest")
    M.save(fitted, folder)
    said = L.diagnosis_scores.select("payment_id", F.col("predicted_bucket").alias("said"), F.col("confidence").alias("sure"))
    known = F.col("predicted_bucket").isin(*O.R.BUCKETS) & (F.col("confidence") > 0) & (F.col("confidence") <= 1)
    forest = M.score_diagnosis(M.load(folder), test).join(said, "payment_id").select(
        F.lit("forest").alias("model"), "payment_id", "actual_bucket",
        (known & (F.col("said") == F.col("predicted_bucket")) & (F.abs(F.col("sure") - F.col("confidence")) < 1e-9)).alias("scored"))
    baseline, held = L.baseline_fit
    return forest.unionByName(M.score_diagnosis(baseline, held).select(F.lit("logistic").alias("model"), "payment_id", "actual_bucket", known.alias("scored")))
