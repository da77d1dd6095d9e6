"""Sources (CSV, single-id lookup), small operators and the full run (QRY-7)."""
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dunning.operators import cases, execution, outcomes, policy
from dunning.plans import full_run
from dunning.plans.layers import Layers
from dunning.sources import committed, lookup_index, sinks
from dunning.sources import payments as P
from dunning.sources.tables import union_all_columns


def test_csv_payments_source(spark):
    d = tempfile.mkdtemp(prefix="dunning-csv-")
    path = os.path.join(d, "payments.csv")
    with open(path, "w") as f:
        f.write("payment_id,customer_id,amount,method,timestamp,status,error_code,error_reason,"
                "error_description,root_cause_bucket\n")
        f.write("pay_a,c1,1234.5,card,2024-03-04T05:06:07,failed,GATEWAY_ERROR,gateway_timeout,x,retryable_transient\n")
        f.write("pay_b,c1,NaN,upi,2024-03-04 05:06:07.123456,failed,,,,\n")
        f.write("pay_c,c2,oops,upi,not a time,captured,,,,\n")
    rows = {r.payment_id: r for r in P.payments_from_csv(spark, path).collect()}
    assert rows["pay_a"].amount == Decimal("1234.50") and rows["pay_a"].timestamp.hour == 5
    assert rows["pay_b"].amount is None and rows["pay_b"].timestamp.microsecond == 123456
    assert rows["pay_c"].amount is None and rows["pay_c"].timestamp is None


def test_single_payment_lookup_pushes_key_to_scan(spark):
    L = Layers.of(spark, SF_SMALL)
    some = L.failed.select("payment_id").orderBy("payment_id").first()[0]
    one = P.payment_by_id(spark, SF_SMALL, some)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey," in plan
    c = cases.case_for_payment(spark, SF_SMALL, some).collect()
    assert len(c) == 1 and c[0].source == "failed" and c[0].action is not None
    assert cases.case_for_payment(spark, SF_SMALL, "pay_999999999").count() == 0
    assert cases.case_for_payment(spark, SF_SMALL, "nonsense").count() == 0


def test_small_operators(spark):
    L = Layers.of(spark, SF_SMALL)
    prev = policy.decision_preview(L.decisions, 8).collect()
    assert [r.payment_id for r in prev] == sorted(r.payment_id for r in L.decisions.select("payment_id").collect())[:8]
    ids = outcomes.first_ids(outcomes.failed_outcomes(L.outcomes), 10).collect()
    assert len(ids) <= 10 and [r[0] for r in ids] == sorted(r[0] for r in ids)
    dec = spark.createDataFrame([("pay_1",), ("nope",)], "payment_id string")
    got = {r.payment_id: r.amount for r in execution.amounts_with_default(dec, L.payments).collect()}
    assert got["nope"] == 0
    u = union_all_columns(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string"))
    assert sorted(u.columns) == ["a", "b"] and u.count() == 2


PRODUCTS = ("policy_decisions", "attempts_log", "recovery_outcomes", "audit_log", "cases", "final_metrics", "webhook_results", "webhook_matches")


def _product(spark, out, name):
    return committed.read_runs(spark, os.path.join(out, name))


def test_full_run_writes_products_and_resumes(spark, monkeypatch):
    out = tempfile.mkdtemp(prefix="dunning-run-")
    # the first try dies while it builds the cases
    def broken(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(full_run.cases, "payment_cases", broken)
        try:
            full_run.run(spark, SF_SMALL, out)
            raise AssertionError
        except RuntimeError as e:
            assert str(e) == "lost"
    assert _product(spark, out, "cases") is None
    before = {n: committed.published(spark, os.path.join(out, n)) for n in PRODUCTS}
    calls = []
    for layer, fn in (("policy", "decide"), ("execution", "route"), ("outcomes", "label_outcomes"), ("cases", "payment_cases")):
        real = getattr(getattr(full_run, layer), fn)
        monkeypatch.setattr(getattr(full_run, layer), fn, lambda *a, _f=real, _n=fn, **k: calls.append(_n) or _f(*a, **k))
    doc = full_run.run(spark, SF_SMALL, out)
    assert calls == ["payment_cases"]  # what stood was taken over
    for n in PRODUCTS[:4]:
        assert committed.published(spark, os.path.join(out, n)) == before[n]
    assert full_run.run(spark, SF_SMALL, out) == doc and calls == ["payment_cases"]
    L = Layers.of(spark, SF_SMALL)
    assert doc["records_evaluated"] == L.failed.count()
    assert doc["recovery_attempts"] == doc["retry_now"]
    assert _product(spark, out, "cases").count() == L.payments.count()
    log = _product(spark, out, "attempts_log")
    assert [r[0].isoformat() for r in log.select("execution_date").distinct().collect()] == ["2024-06-01"] and log.count() == L.attempts.count()
    recovered = spark.read.parquet(os.path.join(out, "recovery_log"))
    assert recovered.count() == _product(spark, out, "webhook_results").filter("status = 'recovered'").count() > 0
    assert _product(spark, out, "webhook_matches").count() == recovered.count()
    # another parameter is another run: decisions stand, attempts are made anew and replace nothing
    full_run.run(spark, SF_SMALL, out, executed_at="2024-07-01 00:00:00", with_webhook=False)
    assert _product(spark, out, "attempts_log").count() == 2 * log.count()


def test_a_run_is_visible_whole_or_not_at_all(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="dunning-commit-"), "log")
    L = Layers.of(spark, SF_SMALL)
    n = L.attempts.count()
    assert sinks.read_attempts(spark, path) is None
    sinks.append_attempts(L.attempts, path, "day1")
    broken = L.attempts.withColumn("notes", F.when(F.col("payment_id") == L.attempts.first().payment_id, F.raise_error(F.lit("lost"))).otherwise(F.col("notes")))
    try:
        sinks.append_attempts(broken, path, "day2")
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert sinks.read_attempts(spark, path).count() == n  # what the dead run wrote is not seen
    sinks.append_attempts(L.attempts, path, "day2")
    sinks.append_attempts(L.attempts, path, "day2")  # a second try of the same run replaces the first
    assert sinks.read_attempts(spark, path).count() == 2 * n
    assert sorted(committed.published(spark, path)) == ["day1", "day2"]
    assert sinks.read_attempts(spark, path).columns == L.attempts.columns
    for bad in ("", "a/b"):
        try:
            committed.write_run(L.attempts, path, bad)
            raise AssertionError
        except ValueError:
            pass


def test_point_lookup_reads_one_bucket(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="dunning-index-"), "cases")
    rows = spark.range(5000).select(F.concat(F.lit("pay_"), F.col("id").cast("string")).alias("payment_id"), (F.col("id") * 2).alias("v"))
    rows = rows.union(spark.createDataFrame([("pay_7", -1), (None, 0)], "payment_id string, v long"))
    lookup_index.write_index(rows, path, "payment_id", buckets=16)
    one = lookup_index.find(spark, path, "payment_id", "pay_7", buckets=16)
    assert sorted(map(tuple, one.collect())) == [("pay_7", -1), ("pay_7", 14)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan and "EqualTo(payment_id,pay_7)" in plan and "Exchange" not in plan
    selected = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0).selectedPartitions()
    assert len(list(selected)) == 1 if not hasattr(selected, "partitionCount") else selected.partitionCount() == 1
    assert lookup_index.find(spark, path, "payment_id", "nope", buckets=16).count() == 0
    asked = spark.createDataFrame([("pay_1",), ("pay_1",), ("pay_7",), ("x",), (None,)], "payment_id string")
    got = sorted(map(tuple, lookup_index.find_all(spark, path, "payment_id", asked, buckets=16).collect()))
    assert got == [("pay_1", 2), ("pay_7", -1), ("pay_7", 14)]


def test_listing_evaluates_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k, float("nan")) for k in range(7)], "k int, v double")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    once = rows.mapInArrow(count, rows.schema)
    got = sinks.records_with_count(once, os.path.join(tempfile.mkdtemp(prefix="dunning-list-"), "l")).collect()
    assert seen.value == 7 and {r["count"] for r in got} == {7} and len(got) == 7 and got[0]["record"].endswith('"v":null}')


def test_universe_one_record_per_id(spark):
    """JON-7/WIN-6: failed row wins over a success with the same id; a repeated
    id within one table gives its earliest row; ids in neither are absent."""
    import datetime as dt
    import decimal
    from dunning.sources.payments import PAYMENT_SCHEMA, payments_universe
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)

    def row(pid, ts, status, amount):
        return (pid, "c", decimal.Decimal(amount), "card", ts, status, None, None, None, None)
    failed = spark.createDataFrame([row("a", t1, "failed", 2), row("a", t0, "failed", 1), row("b", t0, "failed", 3)],
                                   PAYMENT_SCHEMA)
    ok = spark.createDataFrame([row("b", t0, "captured", 4), row("c", t1, "captured", 6),
                                row("c", t0, "captured", 5)], PAYMENT_SCHEMA)
    got = {r.payment_id: (r.source, float(r.amount)) for r in payments_universe(failed, ok).collect()}
    assert got == {"a": ("failed", 1.0), "b": ("failed", 3.0), "c": ("succeeded", 5.0)}
