"""DuckDB SQL for the registered queries (the correctness oracle).

Written independently of the DataFrame code: the Spark side is built with the
DataFrame API, this side is plain SQL over the same parquet views. Shared are
only the fixed values (rule tables, mappings), which are the specification.
"""

from __future__ import annotations

from dunning.operators import execution as ex
from dunning.operators import outcomes as oc
from dunning.operators import rules as R
from dunning.operators import evaluation as ev
from dunning.operators.diagnosis import SHARE_PLACES
from dunning.sources import payments as P

AS_OF = R.PolicyParams().as_of


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def h8(expr: str) -> str:
    return f"CAST(('0x' || substr(sha256({expr}), 1, 8)) AS BIGINT)"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, (int, float)) else q(v)}"
                     for k, v in mapping.items())
    return f"COALESCE(CASE {expr} {whens} END, {default})"


def list_lit(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def dec2_text(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,2)) AS VARCHAR)"


def fixed_text(expr: str, places: int) -> str:
    return f"printf('%.{places}f', CAST({expr} AS DOUBLE))"


def round2_text(expr: str) -> str:
    return fixed_text(expr, 2)


def fmt_inr(expr: str) -> str:
    """Indian grouping, same rule as functions.expr.fmt_inr."""
    d = f"CAST({expr} AS DECIMAL(38,2))"
    txt = f"CAST(abs({d}) AS VARCHAR)"
    ip = f"split_part({txt}, '.', 1)"
    fp = f"split_part({txt}, '.', 2)"
    n = f"length({ip})"
    head = f"substr({ip}, 1, {n} - 3)"
    grouped = f"regexp_replace(reverse(regexp_replace(reverse({head}), '(\\d{{2}})', '\\1,', 'g')), '^,', '')"
    return (f"(CASE WHEN {d} < 0 THEN '-' ELSE '' END || '₹' || "
            f"CASE WHEN {n} > 3 THEN {grouped} || ',' || substr({ip}, {n} - 2, 3) ELSE {ip} END "
            f"|| '.' || {fp})")


def fmt_percent(expr: str) -> str:
    v = f"TRY_CAST(CAST({expr} AS VARCHAR) AS DOUBLE)"
    pct = f"CASE WHEN {v} <= 1 THEN {v} * 100 ELSE {v} END"
    return f"COALESCE({fixed_text(pct, 1)} || '%', 'not available')"


# ---------------------------------------------------------------------------
# CTE fragments
# ---------------------------------------------------------------------------
def cte_payments() -> str:
    reasons = P.FAILURE_REASONS
    parts = [list_lit([r[i] for r in reasons]) for i in range(4)]
    idx = f"({h8(q('reason|') + ' || payment_id')} % {len(reasons)}) + 1"
    method = case_map("o_orderpriority", P.METHOD_BY_PRIORITY, "'other'")
    return f"""
payments_base AS (
  SELECT 'pay_' || CAST(o_orderkey AS VARCHAR) AS payment_id,
         'cust_' || CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         {method} AS method,
         CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey * {P.SECONDS_STRIDE}) % 86400) AS "timestamp",
         o_orderstatus = {q(P.FAILED_ORDER_STATUS)} AS is_failed
  FROM orders),
payments AS (
  SELECT payment_id, customer_id, amount, method, "timestamp",
         CASE WHEN is_failed THEN 'failed' ELSE 'captured' END AS status,
         CASE WHEN is_failed THEN {parts[0]}[{idx}] END AS error_code,
         CASE WHEN is_failed THEN {parts[1]}[{idx}] END AS error_reason,
         CASE WHEN is_failed THEN {parts[2]}[{idx}] END AS error_description,
         CASE WHEN is_failed THEN {parts[3]}[{idx}] END AS root_cause_bucket
  FROM payments_base),
failed AS (SELECT * FROM payments WHERE status = 'failed')"""


def cte_history() -> str:
    return """
history AS (
  SELECT *,
         count(*) OVER (PARTITION BY customer_id ORDER BY "timestamp", payment_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS customer_fail_count,
         CAST(hour("timestamp") AS INTEGER) AS hour_of_day,
         CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week
  FROM failed)"""


def cte_predictions() -> str:
    h = h8(q(f"split|{ev.SPLIT_SEED}|") + " || payment_id")
    return f"""
train AS (
  SELECT error_code, method, root_cause_bucket FROM (
    SELECT *, row_number() OVER (PARTITION BY root_cause_bucket ORDER BY h, payment_id) AS rn,
           count(*) OVER (PARTITION BY root_cause_bucket) AS n
    FROM (SELECT *, {h} AS h FROM failed))
  WHERE rn > (n * {ev.TEST_PERCENT} + 99) // 100 AND root_cause_bucket IS NOT NULL),
shares AS (
  SELECT error_code, method, root_cause_bucket AS predicted_bucket, round(CAST(n AS DOUBLE) / total, {SHARE_PLACES}) AS confidence
  FROM (SELECT *, sum(n) OVER (PARTITION BY error_code, method) AS total,
               row_number() OVER (PARTITION BY error_code, method ORDER BY n DESC, root_cause_bucket) AS rn
        FROM (SELECT error_code, method, root_cause_bucket, count(*) AS n FROM train GROUP BY ALL))
  WHERE rn = 1),
preds AS (
  SELECT p.payment_id, p.error_code, p.amount, p.method, p.hour_of_day, p.day_of_week, p.customer_fail_count,
         p.root_cause_bucket AS actual_bucket, s.predicted_bucket, s.confidence
  FROM history p LEFT JOIN shares s
    ON p.error_code IS NOT DISTINCT FROM s.error_code AND p.method IS NOT DISTINCT FROM s.method)"""


def cte_decisions(attempt_count: str = "0") -> str:
    p = R.PolicyParams()
    cap = case_map("bucket3", p.max_attempts, "0")
    action = case_map("final_bucket_used", p.actions, "'escalate_human'")
    cool = case_map("final_bucket_used", {k: float(v) for k, v in p.cooldown_hours.items()}, "0.0")
    default_reason = case_map("action", R.ACTION_REASONS, "''")
    retry = ", ".join(q(a) for a in R.RETRY_ACTIONS)
    return f"""
dec_a AS (
  SELECT payment_id, predicted_bucket, confidence, amount, {attempt_count} AS attempt_count,
         CASE WHEN confidence < {p.confidence_threshold} THEN 'low_confidence'
              WHEN predicted_bucket = 'escalate_human' THEN 'escalate_bucket'
              WHEN amount > {p.high_value_threshold} AND confidence < {p.high_value_min_confidence}
                THEN 'high_value' END AS gate0
  FROM preds),
dec_b AS (
  SELECT *, CASE WHEN gate0 IN ('low_confidence', 'high_value') THEN 'escalate_human'
                 ELSE predicted_bucket END AS bucket3 FROM dec_a),
dec_c AS (SELECT *, CAST({cap} AS INTEGER) AS cap FROM dec_b),
dec_d AS (SELECT *, COALESCE(gate0 IS NULL AND attempt_count >= cap, false) AS cap_hit FROM dec_c),
dec_e AS (
  SELECT *, CASE WHEN cap_hit THEN 'attempt_cap' ELSE gate0 END AS gate,
            CASE WHEN cap_hit THEN 'escalate_human' ELSE bucket3 END AS final_bucket_used FROM dec_d),
dec_f AS (SELECT *, {action} AS action, {cool} AS cool FROM dec_e),
decisions AS (
  SELECT payment_id, predicted_bucket AS diagnosed_bucket, round(confidence, 3) AS confidence,
         final_bucket_used, action,
         CASE gate
           WHEN 'low_confidence' THEN 'low_confidence:' || {round2_text('confidence')} || '<{p.confidence_threshold}'
           WHEN 'high_value' THEN 'high_value:amount=' || {dec2_text('amount')} || ',confidence=' || {round2_text('confidence')}
           WHEN 'attempt_cap' THEN 'attempt_cap:' || COALESCE(predicted_bucket, '') || '=' || CAST(cap AS VARCHAR)
           ELSE {default_reason} END AS reason,
         CASE WHEN gate IN ('low_confidence', 'high_value', 'attempt_cap') THEN gate ELSE 'default' END
           AS reason_code,
         CAST(attempt_count + 1 AS INTEGER) AS attempt_number,
         cap AS max_attempts_allowed,
         gate IS NOT NULL AS escalate,
         CASE WHEN action IN ({retry}) THEN
           {ts_text(f"TIMESTAMP '{AS_OF}' + to_seconds(CAST(cool * 3600 AS BIGINT))")} END AS retry_at
  FROM dec_f)"""


def cte_universe() -> str:
    """One record per payment id: failed row first, else the successful one."""
    from dunning.sources.payments import PAYMENT_SCHEMA, universe_order
    order = ", ".join(f'"{c}" NULLS FIRST' if c == "timestamp" else f"{c} NULLS FIRST"
                      for c in universe_order([f.name for f in PAYMENT_SCHEMA.fields] + ["source", "__prio"]))
    return f"""
universe AS (
  SELECT * EXCLUDE (__prio, __rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY {order}) AS __rn
    FROM (SELECT *, 'failed' AS source, 0 AS __prio FROM failed
          UNION ALL
          SELECT *, 'succeeded' AS source, 1 AS __prio FROM payments WHERE status <> 'failed'))
  WHERE __rn = 1)"""


def cte_lookup(source: str = "payments") -> str:
    return f"""
lookup AS (
  SELECT payment_id, amount, customer_id FROM (
    SELECT payment_id, amount, customer_id,
           row_number() OVER (PARTITION BY payment_id ORDER BY "timestamp", amount, customer_id) AS rn
    FROM {source}) WHERE rn = 1)"""


def cte_attempts(name: str = "attempts", executed_at: str = ex.DEFAULT_EXECUTED_AT,
                 where: str = "TRUE", with_lookup: bool = True) -> str:
    link = "'plink_' || substr(sha256('link|' || r.payment_id), 1, 14)"
    # the router looks amounts up in the failed-payments table (as the reference does)
    return (cte_lookup("failed") + "," if with_lookup else "") + f"""
{name} AS (
  SELECT r.payment_id,
         r.action AS action_taken,
         CASE WHEN l.payment_id IS NULL THEN 'failed'
              WHEN r.action = 'retry_now' THEN
                CASE WHEN r.payment_id IS NULL OR trim(r.payment_id) = '' OR l.amount IS NULL
                          OR l.amount <= 0 OR round(l.amount * 100) <= 0 THEN 'failed' ELSE 'sent' END
              ELSE 'skipped' END AS execution_status,
         CAST(0 AS DECIMAL(18,2)) AS recovered_amount,
         CASE WHEN l.payment_id IS NULL THEN {q(ex.NOTE_NOT_FOUND)}
              WHEN r.action = 'retry_now' THEN
                CASE WHEN r.payment_id IS NULL THEN {q(ex.NOTE_MISSING_ID)}
                     WHEN trim(r.payment_id) = '' THEN {q(ex.NOTE_EMPTY_ID)}
                     WHEN l.amount IS NULL THEN {q(ex.NOTE_MISSING_AMOUNT)}
                     WHEN l.amount <= 0 THEN 'error=amount_not_positive:' || CAST(l.amount AS VARCHAR)
                     WHEN round(l.amount * 100) <= 0 THEN {q(ex.NOTE_ZERO_MINOR)}
                     ELSE 'payment_link_id=' || {link}
                          || '; reference_id=recovery_' || r.payment_id || '; amount=' || {dec2_text('l.amount')}
                END
              WHEN r.action = 'retry_later' THEN {q(ex.NOTE_RETRY_LATER)}
              WHEN r.action = 'send_reminder' THEN {q(ex.NOTE_REMINDER)}
              WHEN r.action = 'escalate_human' THEN {q(ex.NOTE_HUMAN)}
              ELSE 'error=action_unknown:' || COALESCE(r.action, 'None') END AS notes,
         {q(executed_at)} AS execution_timestamp
  FROM (SELECT trim(CAST(payment_id AS VARCHAR)) AS payment_id, trim(CAST(action AS VARCHAR)) AS action
        FROM decisions WHERE {where}) r
  LEFT JOIN lookup l ON r.payment_id = l.payment_id)"""


def cte_attempts_log(rerun_at: str = "2024-06-02 00:00:00") -> str:
    return (cte_attempts() + "," + cte_attempts("attempts_rerun", rerun_at, "action = 'retry_now'", False)
            + """,
attempts_log AS (SELECT * FROM attempts UNION ALL SELECT * FROM attempts_rerun),
latest_attempt AS (
  SELECT payment_id, action_taken, execution_status, recovered_amount, notes, execution_timestamp FROM (
    SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY execution_timestamp DESC NULLS LAST,
                                 notes DESC NULLS LAST, action_taken DESC NULLS LAST,
                                 execution_status DESC NULLS LAST) AS rn
    FROM attempts_log) WHERE rn = 1)""")


def cte_outcomes(threshold: float = R.OUTCOME_THRESHOLD) -> str:
    prob = f"(({h8('d.payment_id')} % 100) / 100.0)"
    return f"""
outcomes AS (
  SELECT d.payment_id, d.action, p.amount,
         round({prob}, 4) AS recovery_probability,
         CASE WHEN {prob} < {threshold} THEN 'recovered' ELSE 'failed' END AS outcome,
         CAST(CASE WHEN {prob} < {threshold} THEN p.amount ELSE 0 END AS DECIMAL(18,2)) AS recovered_amount,
         CASE WHEN {prob} < {threshold} THEN {q(oc.REASON_RECOVERED)} ELSE {q(oc.REASON_FAILED)} END AS reason
  FROM decisions d LEFT JOIN failed p ON d.payment_id = p.payment_id
  WHERE d.action = 'retry_now')"""


def cte_metrics() -> str:
    return """
pk AS (
  SELECT count(*) AS records_evaluated, count(*) AS policy_decisions,
         count(*) FILTER (WHERE action = 'retry_now') AS retry_now,
         count(*) FILTER (WHERE action = 'retry_later') AS retry_later,
         count(*) FILTER (WHERE action = 'send_reminder') AS send_reminder,
         count(*) FILTER (WHERE action = 'escalate_human') AS human_escalations
  FROM decisions),
ok AS (
  SELECT count(*) AS recovery_attempts,
         count(*) FILTER (WHERE outcome = 'recovered') AS successful_recoveries,
         count(*) FILTER (WHERE outcome = 'failed') AS failed_recoveries,
         CAST(COALESCE(sum(amount), 0) AS DECIMAL(38,2)) AS revenue_at_risk,
         CAST(COALESCE(sum(recovered_amount), 0) AS DECIMAL(38,2)) AS revenue_recovered
  FROM outcomes),
metrics AS (
  SELECT records_evaluated, policy_decisions, retry_now, retry_later, send_reminder, human_escalations,
         recovery_attempts, successful_recoveries, failed_recoveries,
         CASE WHEN recovery_attempts > 0
              THEN round(CAST(successful_recoveries AS DOUBLE) / CAST(recovery_attempts AS DOUBLE) * 100, 2)
              ELSE 0.0 END AS recovery_rate_percent,
         revenue_at_risk, revenue_recovered,
         CAST(revenue_at_risk - revenue_recovered AS DECIMAL(38,2)) AS revenue_unrecovered,
         failed_recoveries + human_escalations AS exception_count,
         'synthetic' AS evaluation_type
  FROM pk, ok)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def hmac_sql(secret: str, body: str) -> str:
    from dunning.functions.expr import hmac_pads
    ipad, opad = hmac_pads(secret)
    inner = f"sha256(unhex('{ipad.hex()}') || encode({body}))"
    return f"sha256(unhex('{opad.hex()}') || unhex({inner}))"


def cte_webhook() -> str:
    from dunning.streaming import webhook as W

    def rng(col, r):
        return f"({col} >= {r[0]} AND {col} < {r[1]})"

    name = case_map("event_type", W.EVENT_NAMES, "'payment_link.unknown'")
    link = "'plink_' || substr(sha256('link|' || pid), 1, 14)"
    pay_entity = ("json_object('entity', json_object('id', 'pay_evt_' || s_eid, 'amount', paise, "
                  "'currency', 'INR', 'status', 'captured'))")
    full = (f"CAST(json_object('event', name, 'payload', json_object('payment_link', json_object('entity', "
            f"json_object('id', {link}, 'amount', paise, 'amount_paid', paise, 'currency', 'INR', "
            f"'reference_id', 'recovery_' || pid)), 'payment', {pay_entity})) AS VARCHAR)")
    no_entity = f"CAST(json_object('event', name, 'payload', json_object('payment', {pay_entity})) AS VARCHAR)"
    good_sig = hmac_sql(W.TEST_SECRET, "body")
    bad_sig = hmac_sql(W.TEST_SECRET + "-wrong", "body")
    return f"""
wev AS (
  SELECT event_id AS eid, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id AS VARCHAR) AS s_eid,
         {h8("'deliv|' || CAST(event_id AS VARCHAR)")} % 100 AS fault,
         'pay_' || CAST(event_id AS VARCHAR) AS pid, {name} AS name,
         CAST(round(value * 100) AS BIGINT) AS paise
  FROM events),
wbody AS (
  SELECT eid, ts, s_eid, fault,
         CASE WHEN {rng('fault', W.FAULT_EMPTY_BODY)} THEN ''
              WHEN {rng('fault', W.FAULT_BAD_JSON)} THEN substr({full}, 1, {W.TRUNCATED_BODY_CHARS})
              WHEN {rng('fault', W.FAULT_NO_ENTITY)} THEN {no_entity}
              ELSE {full} END AS body
  FROM wev),
wonce AS (
  SELECT eid * 2 AS delivery_id, ts AS received_at,
         CASE WHEN {rng('fault', W.FAULT_NO_EVENT_ID)} THEN NULL ELSE 'evt_' || s_eid END AS event_id,
         CASE WHEN {rng('fault', W.FAULT_NO_SIGNATURE)} THEN NULL
              WHEN {rng('fault', W.FAULT_BAD_SIGNATURE)} THEN {bad_sig}
              ELSE {good_sig} END AS signature,
         body, fault
  FROM wbody),
envelopes AS (
  SELECT delivery_id, received_at, event_id, signature, body FROM wonce
  UNION ALL
  SELECT delivery_id + 1, received_at + to_seconds({W.DUPLICATE_DELAY_SECONDS}), event_id, signature, body
  FROM wonce WHERE fault >= {W.FAULT_DUPLICATE_FROM}),
wparsed AS (
  SELECT *, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS pbody FROM envelopes),
wg AS (
  SELECT *,
    CASE WHEN body IS NULL OR body = '' THEN 'rejected_empty_body'
         WHEN signature IS NULL OR signature = '' THEN 'rejected_missing_signature'
         WHEN {good_sig} <> signature THEN 'rejected_bad_signature'
         WHEN pbody IS NULL THEN 'rejected_bad_json' END AS guard,
    json_extract_string(pbody, '$.event') AS event,
    json_extract(pbody, '$.payload.payment_link.entity') AS entity
  FROM wparsed),
wg2 AS (
  SELECT *,
    CASE WHEN guard IS NULL THEN COALESCE(CASE WHEN trim(event_id) <> '' THEN event_id END,
                                          'local_' || sha256(body)) END AS ev_id,
    COALESCE(guard IS NULL AND event = '{W.PAID_EVENT}' AND entity IS NOT NULL, false) AS would
  FROM wg),
wfirst AS (
  SELECT ev_id, received_at AS f_ts, delivery_id AS f_id FROM (
    SELECT ev_id, received_at, delivery_id,
           row_number() OVER (PARTITION BY ev_id ORDER BY received_at, delivery_id) AS rn
    FROM wg2 WHERE would) WHERE rn = 1),
classified AS (
  SELECT w.delivery_id, w.received_at, w.ev_id AS event_id, w.event,
    CASE WHEN w.guard IS NOT NULL THEN w.guard
         WHEN f.ev_id IS NOT NULL AND (f.f_ts < w.received_at OR (f.f_ts = w.received_at AND f.f_id < w.delivery_id))
           THEN 'already_processed'
         WHEN COALESCE(w.event, '') <> '{W.PAID_EVENT}' THEN 'ignored'
         WHEN w.entity IS NULL THEN 'rejected_missing_entity'
         ELSE 'recovered' END AS status,
    json_extract_string(w.pbody, '$.payload.payment_link.entity.id') AS payment_link_id,
    COALESCE(json_extract_string(w.pbody, '$.payload.payment.entity.id'), '') AS payment_id,
    CAST(COALESCE(CAST(json_extract(w.pbody, '$.payload.payment_link.entity.amount_paid') AS BIGINT), 0) AS DOUBLE)
      / 100.0 AS amount,
    COALESCE(json_extract_string(w.pbody, '$.payload.payment_link.entity.currency'), 'INR') AS currency,
    COALESCE(json_extract_string(w.pbody, '$.payload.payment_link.entity.reference_id'), '') AS reference_id
  FROM wg2 w LEFT JOIN wfirst f ON w.ev_id = f.ev_id),
recovered AS (
  SELECT event_id, payment_link_id, payment_id, amount, currency, reference_id, 'recovered' AS status,
         {ts_text('received_at')} AS recovered_at
  FROM classified WHERE status = 'recovered')"""
