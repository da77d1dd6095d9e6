"""STR-3 with expiring state and the recovery log laid out for lookups."""
import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dunning.plans.layers import Layers
from dunning.streaming import dedupe, recovery_log
from dunning.streaming import webhook as W
from test_webhook import _body, _env, _sign

T0 = dt.datetime(2024, 1, 1)


def _rows(spec):
    """(delivery_id, seconds, event_id, kind) -> envelopes."""
    bodies = {"paid": _body(), "other": _body("payment_link.expired"), "no entity": _body(entity=False)}
    return [(d, T0 + dt.timedelta(seconds=s), e, _sign(bodies[k]) if k in bodies else None, bodies.get(k, _body())) for d, s, e, k in spec]


def _statuses(spark, base):
    return {r.delivery_id: r.status for r in spark.read.parquet(os.path.join(base, "results")).collect()}


def test_window_opens_closes_and_survives_a_restart(spark):
    base = tempfile.mkdtemp(prefix="dunning-window-")
    landing, out, ckpt = (os.path.join(base, x) for x in ("landing", "results", "ckpt"))

    def land_and_run(spec):
        W.write_landing(_env(spark, _rows(spec)), landing, files=2)
        dedupe.start_bounded_stream(spark, landing, out, ckpt, W.TEST_SECRET, window_seconds=100).awaitTermination()

    land_and_run([(1, 0, "a", "paid"), (2, 50, "a", "paid"), (3, 99, "a", "other"), (4, 100, "a", "paid"), (5, 10, "b", "other"),
                  (6, 20, "b", "paid"), (7, 0, "c", "unsigned"), (8, 0, "d", "no entity"), (9, 5, "d", "paid"), (10, 6, "d", "no entity")])
    first = _statuses(spark, base)
    assert first == {1: "recovered", 2: "already_processed", 3: "already_processed", 4: "recovered", 5: "ignored", 6: "recovered",
                     7: "rejected_missing_signature", 8: "rejected_missing_entity", 9: "recovered", 10: "already_processed"}
    # a new query on the same checkpoint knows the open windows; late deliveries are reported too
    land_and_run([(11, 150, "a", "paid"), (12, 90, "b", "paid"), (13, 200, "a", "paid"), (14, 30, "a", "paid"), (15, 1, "e", "paid")])
    assert _statuses(spark, base) == first | {11: "already_processed", 12: "already_processed", 13: "recovered", 14: "already_processed",
                                              15: "recovered"}


def test_python_is_called_per_bucket_and_buckets_keep_ids_apart(spark):
    base = tempfile.mkdtemp(prefix="dunning-buckets-")
    paid = [(k, k % 7, f"e{k % 400}", "paid") for k in range(1200)]
    W.write_landing(_env(spark, _rows(paid)), os.path.join(base, "landing"), files=2)
    reader = spark.readStream.schema(W.ENVELOPE_SCHEMA).json(os.path.join(base, "landing"))
    out = dedupe.classified_stream(reader, W.TEST_SECRET, buckets=3)
    with_rocks = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedupe.STATE_STORE)
    try:
        query = (out.writeStream.format("parquet").option("path", os.path.join(base, "results"))
                 .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", with_rocks)
    told = _statuses(spark, base)
    assert len(told) == 1200 and sum(v == "recovered" for v in told.values()) == 400
    assert {k for k, v in told.items() if v == "recovered"} == {
        min((k for k, _, e, _ in paid if e == f"e{i}"), key=lambda k: (k % 7, k)) for i in range(400)}
    # one state value a bucket, not one an id
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 2 * 3  # value and timer


def test_stream_equals_batch_on_given_events(spark):
    base = tempfile.mkdtemp(prefix="dunning-bounded-")
    env = Layers.of(spark, SF_SMALL).envelopes
    W.write_landing(env, os.path.join(base, "landing"), files=6)
    dedupe.start_bounded_stream(spark, os.path.join(base, "landing"), os.path.join(base, "results"), os.path.join(base, "ckpt"),
                                W.TEST_SECRET).awaitTermination()
    assert _statuses(spark, base) == {r.delivery_id: r.status for r in W.classify(env, W.TEST_SECRET).collect()}


def _log_rows(spark, ids, day):
    return spark.createDataFrame([(f"e{i}", f"{day} 00:00:00") for i in ids], "event_id string, recovered_at string")


def _batch(spark, ids, day):
    return spark.createDataFrame([(f"e{i}", dt.datetime.fromisoformat(day)) for i in ids], "__key string, received_at timestamp")


def test_files_read_do_not_grow_with_the_log(spark):
    log = os.path.join(tempfile.mkdtemp(prefix="dunning-log-"), "log")
    batch = _batch(spark, [5], "2024-03-10")
    assert recovery_log.processed_ids(spark, log, batch) is None
    read = []
    for k in range(6):
        recovery_log.write_epoch(_log_rows(spark, range(40), f"2024-0{1 if k else 3}-{20 + k if k else 10}"), log, "r", k)
        read.append(len(recovery_log.processed_ids(spark, log, batch, horizon_days=5).inputFiles()))
    assert read == [1] * 6
    assert len(recovery_log.processed_ids(spark, log, batch, horizon_days=None).inputFiles()) == 6
    assert [r.event_id for r in recovery_log.processed_ids(spark, log, batch, horizon_days=None).collect()] == ["e5"]
    assert recovery_log.processed_ids(spark, log, _batch(spark, [5], "2024-09-01"), horizon_days=5) is None


def test_replayed_epoch_replaces_itself_and_does_not_see_itself(spark):
    log = os.path.join(tempfile.mkdtemp(prefix="dunning-replay-"), "log")
    for _ in range(2):
        recovery_log.write_epoch(_log_rows(spark, range(10), "2024-01-01"), log, "r", 0)
    recovery_log.write_epoch(_log_rows(spark, range(10, 12), "2024-01-01"), log, "r", 1)
    assert sorted(r.event_id for r in spark.read.parquet(log).collect()) == sorted(f"e{i}" for i in range(12))
    batch = _batch(spark, range(20), "2024-01-01")
    seen = {r.event_id for r in recovery_log.processed_ids(spark, log, batch, exclude=("r", 0)).collect()}
    assert seen == {"e10", "e11"}
