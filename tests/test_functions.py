"""Scalar helpers against Python's own definitions."""
import hashlib
import hmac

from pyspark.sql import functions as F

from dunning.functions import expr as X


def test_hash_bucket_fixed_vectors(spark):
    # fixed values: stable bucket = int(sha256(id)[:8], 16) % 100 / 100
    ids = ["pay_86f8a929396a4a", "pay_f5863af444e14d", "pay_8daa230f1bc04f", "pay_ee4d851071674e"]
    expect = [0.27, 0.71, 0.8, 0.79]
    df = spark.createDataFrame([(i,) for i in ids], "payment_id string")
    got = [r[0] for r in df.select(X.hash_fraction("payment_id")).collect()]
    assert got == expect
    assert expect == [int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 100 / 100 for i in ids]


def test_hmac_matches_python(spark):
    secret = "k3y-for-tests"
    bodies = ['{"event":"payment_link.paid"}', "", "x" * 200, "ünïcode ✓"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r[0] for r in df.select(X.hmac_sha256_hex(secret, F.col("body"))).collect()]
    want = [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
    assert got == want
    long_key = "k" * 100
    got = df.select(X.hmac_sha256_hex(long_key, F.col("body"))).first()[0]
    assert got == hmac.new(long_key.encode(), bodies[0].encode(), hashlib.sha256).hexdigest()


def test_fixed_text_rounds_like_python(spark):
    vals = [0.285, 0.125, 0.375, 0.675, 0.999, 0.005, 2.675]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(X.round2_text("v")).collect()]
    assert got == ["%.2f" % v for v in vals]


def test_percent_and_money_text(spark):
    df = spark.createDataFrame([("0.377", "290647.66"), ("85", "999.5"), ("abc", "-1234567.891"), (None, "0")],
                               "c string, a string")
    rows = df.select(X.fmt_percent("c").alias("p"), X.fmt_inr(F.col("a").cast("decimal(20,3)")).alias("m")).collect()
    assert [r.p for r in rows] == ["37.7%", "85.0%", "not available", "not available"]
    assert [r.m for r in rows] == ["₹2,90,647.66", "₹999.50", "-₹12,34,567.89", "₹0.00"]


def test_minor_units_and_humanize(spark):
    df = spark.createDataFrame([(1234.565, "send_reminder"), (0.004, "escalate-human")], "a double, k string")
    rows = df.select(X.to_minor_units("a").alias("m"), X.humanize("k").alias("h")).collect()
    assert [r.m for r in rows] == [int(round(1234.565 * 100)), 0]
    assert [r.h for r in rows] == ["Send Reminder", "Escalate Human"]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "v double")
    assert [r[0] for r in df.select(X.nan_to_null("v")).collect()] == [None, None, 1.5]


def test_timestamps_with_fractions_and_zones(spark):
    from dunning.functions.expr import ts_text
    from dunning.sources.payments import parse_timestamp
    texts = ["2024-05-06T07:08:09.000Z", "2024-05-06 07:08:09.5", "2024-05-06T07:08:09+02:00", "2024-05-06 07:08:09",
             "2024-05-06 07:08", "2024-05-06", " 2024-05-06T07:08:09 ", "2024", "07:08:09", "2024-13-01", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(ts_text(parse_timestamp("t"))).collect()]
    day = "2024-05-06 "
    assert got == [day + "07:08:09", day + "07:08:09", day + "05:08:09", day + "07:08:09", day + "07:08:00", day + "00:00:00",
                   day + "07:08:09", None, None, None, None, None]


def test_odds_without_a_paid_payment_are_infinite_and_null_in_records(spark, tmp_path):
    from dunning.operators.features import customer_odds
    from dunning.sources.sinks import records_with_count
    pay = spark.createDataFrame([("a", "failed"), ("a", "captured"), ("a", "captured"), ("b", "failed"), (None, "captured")], "customer_id string, status string")
    odds = customer_odds(pay)
    assert {r.customer_id: r.odds for r in odds.collect()} == {"a": 0.5, "b": float("inf"), None: 0.0}
    assert sorted(r.record for r in records_with_count(odds, str(tmp_path / "odds")).collect()) == [
        '{"customer_id":"a","failed":1,"paid":2,"odds":0.5}', '{"customer_id":"b","failed":1,"paid":0,"odds":null}',
        '{"customer_id":null,"failed":0,"paid":1,"odds":0.0}']
