"""Model invariants (library algorithms differ from the reference's, so no
value parity): probabilities, confidence range, importances, persistence."""
import os
import tempfile

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dunning.operators import diagnosis, evaluation, models
from dunning.plans.layers import Layers


def test_forest_invariants(spark):
    feats = diagnosis.diagnosis_features(Layers(spark, SF_SMALL).failed)
    fitted, test = models.fit_diagnosis(feats, num_trees=20)
    scored = models.score_diagnosis(fitted, test)
    k = len(fitted.stages[-2].labels)
    stats = scored.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"),
                       F.count(F.lit(1)).alias("n")).collect()[0]
    assert stats.n == test.count() > 0
    assert 1.0 / k - 1e-9 <= stats.lo and stats.hi <= 1.0 + 1e-9
    probs = fitted.transform(test.withColumn("class_weight", F.lit(1.0))).select(
        F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert probs.filter(F.abs(F.col("s") - 1.0) > 1e-6).count() == 0
    imp = models.feature_importance(fitted, top=100)
    assert abs(sum(v for _, v in imp) - 1.0) < 1e-6
    assert {n for n, _ in imp} >= set(models.NUMERIC)
    d = tempfile.mkdtemp(prefix="dunning-model-")
    models.save(fitted, os.path.join(d, "m"))
    again = models.score_diagnosis(models.load(os.path.join(d, "m")), test)
    assert sorted(again.collect()) == sorted(scored.collect())


def test_training_rows_are_dealt_evenly_and_like_rows_lie_together(spark):
    feats = diagnosis.diagnosis_features(Layers(spark, SF_SMALL).failed)
    train, test = models.split_diagnosis(feats.coalesce(1))
    sizes = [r["count"] for r in train.unionByName(test).groupBy(F.spark_partition_id() % train.rdd.getNumPartitions()).count().collect()]
    assert len(sizes) == 2 * spark.sparkContext.defaultParallelism
    assert max(sizes) <= 1.3 * sum(sizes) / len(sizes)
    keys = ["error_code", "method", "actual_bucket", "hour_of_day"]
    for part in train.select(*keys).rdd.glom().collect():
        assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)
    assert sorted(r.payment_id for r in train.unionByName(test).collect()) == sorted(r.payment_id for r in feats.collect())
    assert models.laid_out(feats, 10 * models.ROWS_PER_TASK * spark.sparkContext.defaultParallelism).rdd.getNumPartitions() == (
        10 * spark.sparkContext.defaultParallelism)


def test_models_share_one_split(spark):
    layers = Layers(spark, SF_SMALL)
    split = layers.diagnosis_split
    assert layers.baseline_fit[1] is split[1] and layers.diagnosis_split is split


def test_split_is_exact_per_class_and_repeatable(spark):
    p = Layers(spark, SF_SMALL).predictions
    s = evaluation.split_summary(p).collect()
    for r in s:
        n = r.n_train + r.n_test
        assert r.n_test == -(-n * evaluation.TEST_PERCENT // 100)      # ceil, exactly
    assert sorted(evaluation.split_summary(p).collect()) == sorted(s)


def test_split_rows_equal_sql_window_form(spark, duck):
    """Row by row, the block-ranked split equals the plain per-class window."""
    from dunning.plans.catalog import ORACLE
    p = Layers(spark, SF_SMALL).predictions
    got = sorted((r.payment_id, r.split) for r in evaluation.with_split(p).select("payment_id", "split").collect())
    sql = ORACLE["stratified_split"]
    ctes, _ = sql.rsplit("\nSELECT actual_bucket AS label", 1)
    from dunning.plans.catalog import _split_sql
    want = sorted(duck.execute(f"{ctes}\nSELECT payment_id, split FROM {_split_sql()}").fetchall())
    assert got == want and len(got) > 0


def test_split_with_a_dominant_class(spark):
    """One class holds 90 % of the rows (and one label is NULL): still exact."""
    rows = [(f"pay_{i}", "big" if i % 10 else ("small" if i % 20 else None)) for i in range(4000)]
    df = spark.createDataFrame(rows, "payment_id string, actual_bucket string")
    got = {(r.actual_bucket, r.split): r.n for r in
           evaluation.with_split(df).groupBy("actual_bucket", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("big", "test"): 900, ("big", "train"): 2700, ("small", "test"): 50, ("small", "train"): 150,
                   (None, "test"): 50, (None, "train"): 150}
    plan = evaluation.with_split(df)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("__op" in w for w in windows)  # no window over a class's rows, only over its totals per partition


def test_every_row_is_scored_by_a_model_that_did_not_see_it(spark):
    from dunning.operators import features
    seen = {}
    rows = models.with_fold(features.customer_risk_features(Layers.of(spark, SF_SMALL).payments))

    def fit(train):
        ids = {r.payment_id for r in train.select("payment_id").collect()}
        return ids

    def score(ids, test):
        got = {r.payment_id for r in test.select("payment_id").collect()}
        assert got and not got & ids
        seen.update(dict.fromkeys(got, len(ids)))
        return test.select("payment_id")

    out = models.cross_fitted(rows.drop("fold"), fit, score, folds=4)
    assert out.count() == len(seen) == rows.count()
    assert min(seen.values()) > rows.count() // 2
    twice = models.with_fold(spark.createDataFrame([("a",), ("a",), (None,), ("",)], "payment_id string"), 5).collect()
    assert twice[0].fold == twice[1].fold and all(0 <= r.fold < 5 for r in twice)


def test_policy_decides_every_payment_with_the_model(spark):
    import tempfile
    from dunning.plans import full_run
    from dunning.sources import committed
    out = tempfile.mkdtemp(prefix="dunning-model-")
    doc = full_run.run(spark, SF_SMALL, out, use_model=True, with_webhook=False)
    failed = Layers.of(spark, SF_SMALL).failed
    decisions = committed.read_runs(spark, out + "/policy_decisions")
    assert decisions.count() == failed.count() == doc["records_evaluated"]
    assert decisions.join(failed, "payment_id", "left_anti").count() == 0 and decisions.where("confidence is null").count() == 0


def test_encoder_leaves_unseen_and_null_values_without_a_slot(spark):
    cols = "payment_id string, error_code string, method string, amount double, hour_of_day int, day_of_week int, customer_fail_count long"
    train = spark.createDataFrame([("a", "E1", "card", 1.0, 2, 3, 4), ("b", "E2", "upi", 5.0, 6, 0, 0)], cols)
    rows = spark.createDataFrame([("c", "E2", "card", 7.0, 1, 1, 9), ("d", "new", "upi", 0.0, 0, 0, 0), ("e", None, "new", 0.0, 0, 0, 0)], cols)
    got = {r.payment_id: r for r in models.encoded(models.fit_encoder(train), rows).collect()}
    assert [got[k].active for k in "cde"] == ["error_code_E2,method_card", "method_upi", ""]
    assert (got["c"].amount, got["c"].hour_of_day, got["c"].day_of_week, got["c"].customer_fail_count) == (7.0, 1.0, 1.0, 9.0)
