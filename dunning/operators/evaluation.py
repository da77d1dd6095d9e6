"""Model evaluation (EVL-1..4, AGG-13, ML-3, SRT-5).

Every metric starts with ONE partial aggregate over the scored table —
``groupBy(actual, predicted).count()`` — which has at most k*k rows for k
classes; everything after that runs on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dunning.functions.expr import salted_hash8
from dunning.operators.features import prior_totals
from dunning.operators.rules import BUCKETS
from dunning.sources.tables import literal_table

SPLIT_SEED = 42
TEST_PERCENT = 25          # per class, ceil(25 % of its rows) go to test
RISK_FLAG_THRESHOLD = 0.5
METRIC_PLACES = 6


def pair_counts(scored: DataFrame, actual: str = "actual_bucket", predicted: str = "predicted_bucket") -> DataFrame:
    return (scored.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def accuracy(scored: DataFrame, actual="actual_bucket", predicted="predicted_bucket") -> DataFrame:
    """EVL-1."""
    hit = F.col(actual) == F.col(predicted)
    m = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"))
    return m.withColumn("accuracy", F.when(F.col("n") > 0, F.round(F.col("correct") / F.col("n"), METRIC_PLACES))
                        .otherwise(F.lit(0.0)))


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def classification_report(scored: DataFrame, actual="actual_bucket", predicted="predicted_bucket") -> DataFrame:
    """EVL-2: per-class precision/recall/f1/support + 'macro avg' and
    'weighted avg' rows (zero_division=0); labels = those seen in either column."""
    pc = pair_counts(scored, actual, predicted)
    # every (actual, predicted, n) cell credits support to `actual`, a
    # prediction to `predicted`, and a true positive when they agree: one
    # explode + one aggregate over at most k*k cells
    cell = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted_n"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted_n"),
                 F.lit(0).cast("long").alias("tp"))))
    per = (pc.select(cell.alias("c")).select("c.*").filter(F.col("label").isNotNull())
           .groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                 F.sum("predicted_n").alias("predicted_n")))
    per = per.select("label", "support",
                     _ratio(F.col("tp").cast("double"), F.col("predicted_n").cast("double")).alias("precision"),
                     _ratio(F.col("tp").cast("double"), F.col("support").cast("double")).alias("recall"))
    per = per.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    per = per.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    # averages over the (at most k) per-class rows; one tiny window-free aggregate
    avg = per.agg(
        (F.sum("precision") / F.count(F.lit(1))).alias("mp"), (F.sum("recall") / F.count(F.lit(1))).alias("mr"),
        (F.sum("f1") / F.count(F.lit(1))).alias("mf"), F.sum("support").alias("s"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    macro = avg.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("s").alias("support"))
    weighted = avg.select(F.lit("weighted avg").alias("label"), _ratio(F.col("wp"), F.col("s")).alias("precision"),
                          _ratio(F.col("wr"), F.col("s")).alias("recall"), _ratio(F.col("wf"), F.col("s")).alias("f1"),
                          F.col("s").alias("support"))
    out = per.unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(c, METRIC_PLACES).alias(c) for c in ("precision", "recall", "f1")],
                      F.coalesce(F.col("support"), F.lit(0)).cast("long").alias("support"))


def confusion_matrix(spark: SparkSession, scored: DataFrame, labels=None, actual="actual_bucket",
                     predicted="predicted_bucket") -> DataFrame:
    """EVL-3: rows = actual label, one column per predicted label, zeros filled,
    every label on both axes (fixed label list -> pivot without a distinct job)."""
    labels = sorted(labels or BUCKETS)
    pc = pair_counts(scored, actual, predicted).filter(F.col("actual").isin(*labels))
    wide = pc.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))
    dim = literal_table(spark, [(x,) for x in labels], "actual string")
    out = F.broadcast(dim).join(wide, "actual", "left")
    return out.select("actual", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in labels])


def sorted_labels(df: DataFrame, col: str = "actual_bucket") -> DataFrame:
    """SRT-5."""
    return df.select(F.col(col).alias("label")).filter(F.col("label").isNotNull()).distinct().orderBy("label")


def with_split(df: DataFrame, label: str = "actual_bucket", seed: int = SPLIT_SEED,
               test_percent: int = TEST_PERCENT) -> DataFrame:
    """ML-3: exact, repeatable stratified split; adds ``split`` = test / train.

    Within each class the rows are ordered by a salted SHA-256 bucket of the id
    (then the id); the first ceil(test_percent % of n_c) rows are the test set,
    so every class keeps its exact share (integer arithmetic, no sampling).

    The rank inside a class is ``prior_totals``, a parallel scan of range-partitioned
    rows, not a window ``PARTITION BY class``: with five classes such a window would put a
    fifth (or, for a dominant class, most) of the data into one task. Class sizes come from
    one more partial aggregate (k rows)."""
    h = salted_hash8(f"split|{seed}|", F.col("payment_id"))
    cls = "__cls"   # null labels form their own class (the join keys must not be NULL)
    src = df.withColumns({"__h": h, cls: F.coalesce(F.col(label), F.lit("\u0000null"))})
    ranked = prior_totals(src, cls, ["__h", "payment_id"], {"__rank": F.lit(1)})
    sizes = src.groupBy(cls).agg(F.count(F.lit(1)).alias("__n"))
    n_test = F.floor((F.col("__n") * F.lit(test_percent) + F.lit(99)) / F.lit(100))
    out = ranked.join(F.broadcast(sizes), cls, "inner")  # one row per class
    return out.select(*df.columns, F.when(F.col("__rank") < n_test, F.lit("test")).otherwise(F.lit("train"))
                      .alias("split"))


def split_summary(df: DataFrame, label: str = "actual_bucket") -> DataFrame:
    s = with_split(df, label)
    return (s.groupBy(F.col(label).alias("label"))
            .agg(F.count_if(F.col("split") == "train").alias("n_train"),
                 F.count_if(F.col("split") == "test").alias("n_test")))


def class_weights(train: DataFrame, label: str = "actual_bucket") -> DataFrame:
    """AGG-13: 'balanced' weights n / (k * n_c). The window runs over the
    per-class table (k rows), never over the data."""
    counts = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select("label", "n_c", F.round(F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")),
                                                 METRIC_PLACES).alias("weight"))


def smoothed_risk_scores(features: DataFrame) -> DataFrame:
    """ML-10 / FLT-6 from the data alone: the customer's prior failure rate, smoothed by one
    failed and one paid payment; flagged from ``RISK_FLAG_THRESHOLD``."""
    n = F.col("customer_txn_count_so_far")
    score = (F.round(F.col("customer_prior_fail_rate") * n) + 1) / (n + 2)
    return (features.withColumn("risk_score", score)
            .withColumn("flagged_at_risk", (F.col("risk_score") >= RISK_FLAG_THRESHOLD).cast("int")))


def binary_confusion(scored: DataFrame, truth: str = "actual_at_risk", flag: str = "flagged_at_risk") -> DataFrame:
    """EVL-4: TN/FP/FN/TP + accuracy, precision, recall in one aggregate."""
    t, f = F.col(truth) == 1, F.col(flag) == 1
    m = scored.agg(F.count_if(~t & ~f).alias("tn"), F.count_if(~t & f).alias("fp"),
                   F.count_if(t & ~f).alias("fn"), F.count_if(t & f).alias("tp"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return m.select("tn", "fp", "fn", "tp",
                    F.round(_ratio((F.col("tn") + F.col("tp")).cast("double"), n.cast("double")), METRIC_PLACES).alias("accuracy"),
                    F.round(_ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), METRIC_PLACES).alias("precision"),
                    F.round(_ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), METRIC_PLACES).alias("recall"))
