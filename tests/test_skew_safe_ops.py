"""Skew-safe operators give exactly what the plain forms give, including
when one key holds a large share of all rows."""
import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dunning.operators.features import prior_totals
from dunning.operators.joins import first_per_key, latest_per_key


def _events(spark):
    rows = []
    base = dt.datetime(2024, 1, 1)
    for i in range(3000):                      # one hot customer: a third of all rows
        cust = "hot" if i % 3 == 0 else f"c{i % 37}"
        ts = base + dt.timedelta(minutes=(i * 7919) % (60 * 24 * 20))
        rows.append((f"p{i}", cust, ts, i % 2))
    rows.append(("tie_b", "c1", base, 1))      # equal timestamps: id decides
    rows.append(("tie_a", "c1", base, 0))
    return spark.createDataFrame(rows, "payment_id string, customer_id string, timestamp timestamp, f int")


def _nulls(spark):
    """The events plus rows with a null customer, a null time and a null id."""
    extra = [("n1", None, dt.datetime(2024, 1, 2), 1), ("n2", None, dt.datetime(2024, 1, 1), 1), ("n3", "c1", None, 1),
             ("n4", None, None, 0), (None, "c1", dt.datetime(2024, 1, 3), 1), ("n5", "hot", None, 1)]
    df = _events(spark)
    return df.union(spark.createDataFrame(extra, df.schema))


@pytest.fixture(params=[1, 7, 40])
def partitions(spark, request):
    names = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def test_hot_hour_of_one_customer_is_cut(spark, partitions):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"p{k:05d}", "hot", base + dt.timedelta(seconds=(k * 7) % 3600)) for k in range(4000)] + [("q", "cold", base)]
    got = prior_totals(spark.createDataFrame(rows, "payment_id string, customer_id string, timestamp timestamp"), "customer_id",
                       ["timestamp", "payment_id"], {"n": F.lit(1)})
    sizes = [r["c"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("c")).collect()]
    assert partitions == 1 or max(sizes) < 3 * 4001 / partitions
    hot = sorted((r for r in got.collect() if r.customer_id == "hot"), key=lambda r: (r.timestamp, r.payment_id))
    assert [r.n for r in hot] == list(range(4000))


def test_prior_totals_of_an_empty_table(spark):
    assert prior_totals(_events(spark).limit(0), "customer_id", ["timestamp"], {"n": F.lit(1)}).collect() == []


def test_prior_totals_equals_window(spark, partitions):
    df = _nulls(spark)
    got = prior_totals(df, "customer_id", ["timestamp", "payment_id"], {"n": F.lit(1), "fails": F.col("f")})
    w = (Window.partitionBy("customer_id").orderBy(F.col("timestamp").asc_nulls_last(), F.col("payment_id").asc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, -1))
    want = df.select("payment_id", F.count(F.lit(1)).over(w).alias("n"),
                     F.coalesce(F.sum("f").over(w), F.lit(0)).alias("fails"))
    a = sorted(((r.payment_id, r.n, r.fails) for r in got.select("payment_id", "n", "fails").collect()), key=str)
    b = sorted(((r.payment_id, r.n, r.fails) for r in want.collect()), key=str)
    assert a == b and len(a) == df.count()
    assert dict((r[0], r[1]) for r in a)["tie_a"] < dict((r[0], r[1]) for r in a)["tie_b"]


def test_split_keeps_rows_without_id_or_label(spark):
    from dunning.operators.evaluation import with_split
    rows = [(None, "x"), ("a", None), ("b", "x"), (None, None), ("c", "x"), ("c", "x")]
    df = spark.createDataFrame(rows, "payment_id string, actual_bucket string")
    got = sorted(((r.payment_id, r.actual_bucket) for r in with_split(df).collect()), key=str)
    assert got == sorted(rows, key=str)


def test_first_and_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 5, "q")],
                               "k string, t int, v string")
    first = {r.k: r.v for r in first_per_key(df, "k", ["t"]).collect()}
    last = {r.k: r.v for r in latest_per_key(df, "k", ["t"]).collect()}
    assert first == {"a": "x", "b": "q"} and last == {"a": "y", "b": "q"}


def test_later_fields_override_in_a_case(spark):
    from dunning.operators.joins import override_join
    left = spark.createDataFrame([("a", 1, "l", "f"), ("b", 2, "l", "f")], "payment_id string, amount int, note string, source string")
    right = spark.createDataFrame([("a", None, 9)], "payment_id string, note string, extra int")
    got = {r.payment_id: tuple(r) for r in override_join(left, right, "payment_id").collect()}
    assert got == {"a": ("a", 1, None, "f", 9), "b": ("b", 2, "l", "f", None)}


def test_audit_has_one_schema_with_and_without_layers(spark):
    from conftest import SF_SMALL
    from dunning.operators import audit
    from dunning.plans.layers import Layers
    L = Layers.of(spark, SF_SMALL)
    full = audit.audit_table(L.failed, L.decisions, L.attempts_log)
    want = [(f.name, f.dataType) for f in full.schema.fields]
    for d, a in ((None, None), (L.decisions, None), (None, L.attempts_log)):
        part = audit.audit_table(L.failed, d, a)
        assert sorted((f.name, str(f.dataType)) for f in part.schema.fields) == sorted((n, str(t)) for n, t in want)
        assert part.count() >= L.failed.count()


def test_class_shares_are_broadcast(spark):
    from conftest import SF_SMALL
    from dunning.operators import diagnosis
    from dunning.plans.layers import Layers
    df = diagnosis.class_share_scores(Layers.of(spark, SF_SMALL).failed)
    above = df._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0]  # without how the shares were counted
    assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above and "Exchange hashpartitioning" not in above
