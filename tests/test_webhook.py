"""Webhook consumer: batch rules, streaming replay, and the contains() form."""
import hashlib
import hmac
import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dunning.plans.layers import Layers
from dunning.sources.tables import read_table
from dunning.streaming import webhook as W


def _env(spark, rows):
    return spark.createDataFrame(rows, W.ENVELOPE_SCHEMA)


def _sign(body, secret=W.TEST_SECRET):
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def _body(event="payment_link.paid", link="plink_x", entity=True):
    payload = {"payment": {"entity": {"id": "pay_evt_1", "amount": 100, "currency": "INR", "status": "captured"}}}
    if entity:
        payload["payment_link"] = {"entity": {"id": link, "amount": 100, "amount_paid": 100, "currency": "INR",
                                              "reference_id": "recovery_1"}}
    return json.dumps({"event": event, "payload": payload}, separators=(",", ":"))


def test_each_rule(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    ok = _body()
    rows = [
        (1, t, "e1", _sign(ok), ok),
        (2, t + dt.timedelta(seconds=5), "e1", _sign(ok), ok),                # duplicate
        (3, t, "e2", None, ok),                                               # no signature
        (4, t, "e3", "deadbeef", ok),                                         # bad signature
        (5, t, "e4", _sign("{oops"), "{oops"),                                # bad json
        (6, t, "e5", _sign(_body("payment_link.expired")), _body("payment_link.expired")),
        (7, t, "e6", _sign(_body(entity=False)), _body(entity=False)),
        (8, t, "e7", _sign(""), ""),
        (9, t, None, _sign(_body(link="plink_y")), _body(link="plink_y")),    # fallback id
    ]
    c = {r.delivery_id: r for r in W.classify(_env(spark, rows), W.TEST_SECRET).collect()}
    assert [c[i].status for i in range(1, 10)] == [
        "recovered", "already_processed", "rejected_missing_signature", "rejected_bad_signature",
        "rejected_bad_json", "ignored", "rejected_missing_entity", "rejected_empty_body", "recovered"]
    assert c[9].event_id == "local_" + hashlib.sha256(_body(link="plink_y").encode()).hexdigest()
    assert c[1].amount == 1.0 and c[1].payment_id == "pay_evt_1"
    prior = spark.createDataFrame([("e1",)], "event_id string")
    c2 = {r.delivery_id: r.status for r in W.classify(_env(spark, rows), W.TEST_SECRET, prior).collect()}
    assert c2[1] == "already_processed" and c2[2] == "already_processed"


def test_stream_replay_changes_nothing(spark):
    base = tempfile.mkdtemp(prefix="dunning-wh-")
    landing, out, ckpt = (os.path.join(base, x) for x in ("landing", "out", "ckpt"))
    env = W.envelopes_from_events(read_table(spark, SF_SMALL, "events"), W.TEST_SECRET)
    W.write_landing(env, landing)
    L = Layers(spark, SF_SMALL)
    q = W.start_stream(spark, landing, out, ckpt, W.TEST_SECRET, attempts=L.attempts_log)
    q.awaitTermination()
    log1 = spark.read.parquet(os.path.join(out, "recovery_log")).count()
    batch = W.recoveries(W.classify(env, W.TEST_SECRET)).count()
    assert log1 == batch > 0
    # the same deliveries land again: every one is a duplicate now
    W.write_landing(env, landing)
    q = W.start_stream(spark, landing, out, ckpt, W.TEST_SECRET, attempts=L.attempts_log)
    q.awaitTermination()
    log2 = spark.read.parquet(os.path.join(out, "recovery_log")).count()
    assert log2 == log1
    res = spark.read.parquet(os.path.join(out, "results"))
    assert res.filter("status = 'recovered'").count() == log1
    m = spark.read.parquet(os.path.join(out, "matches"))
    assert m.count() == log1 and m.filter("matched").count() > 0


def _brute_force_contains(recovered, attempts):
    """The literal rule on the driver (small fixture only): scan the log in
    (execution_timestamp, notes, action, status) order, first row whose notes
    contain the link id wins."""
    log = sorted(attempts.collect(), key=lambda r: (r.execution_timestamp, r.notes, r.action_taken,
                                                    r.execution_status))
    out = {}
    for r in recovered.collect():
        hit = next((a for a in log if r.payment_link_id and r.payment_link_id in (a.notes or "")), None)
        out[r.event_id] = hit.payment_id if hit else None
    return out


def test_equi_match_equals_contains_match(spark):
    L = Layers.of(spark, SF_SMALL)
    rec = W.recoveries(W.classify(W.envelopes_from_events(read_table(spark, SF_SMALL, "events"), W.TEST_SECRET), W.TEST_SECRET))
    a = {r.event_id: r.matched_payment_id for r in W.match_recoveries(rec, L.attempts_log).collect()}
    assert a == _brute_force_contains(rec, L.attempts_log)
    assert any(v is not None for v in a.values())


def test_watermark_dedupe_is_a_stream_op(spark):
    env = W.envelopes_from_events(read_table(spark, SF_SMALL, "events"), W.TEST_SECRET).filter(F.col("event_id").isNotNull())
    d = tempfile.mkdtemp(prefix="dunning-wm-")
    env.write.json(os.path.join(d, "in"))
    s = spark.readStream.schema(W.ENVELOPE_SCHEMA).json(os.path.join(d, "in"))
    q = (W.dedupe_within_watermark(s).writeStream.format("parquet")
         .option("path", os.path.join(d, "out")).option("checkpointLocation", os.path.join(d, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(d, "out"))
    assert got.count() == env.select("event_id").distinct().count()


def test_hot_event_id_dedupes_exactly(spark):
    """One event id delivered 600 times (a retry storm holding most rows):
    exactly one recovery, every other delivery already_processed."""
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    ok = _body()
    rows = [(i, t + dt.timedelta(seconds=i % 50), "hot", _sign(ok), ok) for i in range(600)]
    rows += [(1000 + i, t, f"e{i}", _sign(ok), ok) for i in range(200)]
    c = W.classify(_env(spark, rows), W.TEST_SECRET)
    got = {r.status: r["count"] for r in c.filter(F.col("event_id") == "hot").groupBy("status").count().collect()}
    assert got == {"recovered": 1, "already_processed": 599}
    first = c.filter((F.col("event_id") == "hot") & (F.col("status") == "recovered")).first()
    assert first.delivery_id == 0
    assert c.filter(F.col("event_id") != "hot").filter("status = 'recovered'").count() == 200


def test_state_store_dedupe_stream(spark):
    base = tempfile.mkdtemp(prefix="dunning-ss-")
    landing, log, ckpt = (os.path.join(base, x) for x in ("landing", "log", "ckpt"))
    env = W.envelopes_from_events(read_table(spark, SF_SMALL, "events"), W.TEST_SECRET)
    W.write_landing(env, landing)
    W.start_recovery_log_stream(spark, landing, log, ckpt, W.TEST_SECRET).awaitTermination()
    want = W.recoveries(W.classify(env, W.TEST_SECRET)).select("event_id").distinct().count()
    assert spark.read.parquet(log).count() == want > 0
    W.write_landing(env, landing)                      # every delivery again
    W.start_recovery_log_stream(spark, landing, log, ckpt, W.TEST_SECRET).awaitTermination()
    got = spark.read.parquet(log)
    assert got.count() == want and got.select("event_id").distinct().count() == want


def test_amounts_and_text_after_the_body(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    def paid(value):
        return _body().replace('"amount_paid":100', f'"amount_paid":{value}')
    bodies = [paid('"50000"'), paid("50000.0"), paid("50000"), paid('"abc"'), paid("null"), _body() + " junk", _body() + "]", _body() + "}",
              _body() + _body(), " " + _body() + " "]
    rows = [(k, t, f"e{k}", _sign(b), b) for k, b in enumerate(bodies)]
    got = {r.delivery_id: (r.status, r.amount) for r in W.classify(_env(spark, rows), W.TEST_SECRET).collect()}
    assert [got[k] for k in range(3)] == [("recovered", 500.0)] * 3
    assert got[3][0] == "rejected_bad_amount" and got[4] == ("recovered", 0.0)
    assert [got[k][0] for k in range(5, 9)] == ["rejected_bad_json"] * 4 and got[9] == ("recovered", 1.0)


def test_fresh_checkpoint_keeps_the_log(spark):
    base = tempfile.mkdtemp(prefix="dunning-fresh-")
    import datetime as dt
    out = os.path.join(base, "out")
    for run, ids in enumerate((range(0, 5), range(3, 8))):
        landing, ckpt = os.path.join(base, f"landing{run}"), os.path.join(base, f"ckpt{run}")
        rows = [(i + 100 * run, dt.datetime(2024, 1, 1), f"e{i}", _sign(_body()), _body()) for i in ids]
        W.write_landing(_env(spark, rows), landing)
        W.start_stream(spark, landing, out, ckpt, W.TEST_SECRET).awaitTermination()
    log = [r.event_id for r in spark.read.parquet(os.path.join(out, "recovery_log")).collect()]
    assert sorted(log) == [f"e{i}" for i in range(8)]


def test_rows_of_one_file_split_are_spread_over_tasks(spark, tmp_path):
    from dunning.sources import tables
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    scan = tables.read_table(spark, str(tmp_path), "events")
    assert scan.rdd.getNumPartitions() == 1
    dealt = tables.spread(scan, rows_per_task=50)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 60
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert tables.spread(scan).rdd.getNumPartitions() == 1  # small tables stay as they are
