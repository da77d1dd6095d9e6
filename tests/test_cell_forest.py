"""The forest grown on cells: splits against brute force, the same forest as Spark ML's but for its draws, work by cells."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dunning.operators import diagnosis, forest, models
from dunning.plans.layers import Layers


def _frame(spark, n, copies=1):
    rows = spark.range(n * copies).select((F.col("id") % n).alias("id"))
    rows = rows.select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                       F.when(F.col("id") % 11 > 0, F.hash("id") / 1000).alias("c"))
    label = F.when(F.col("a") > 3, F.when(F.col("b") <= 1, 0).otherwise(1)).otherwise(F.when(F.col("c") > 0, 2).otherwise(0))
    rows = rows.withColumn("label", label.cast("double")).withColumn("w", F.lit(1.0))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(rows)


def test_splits_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    n, n_bins, weights = 400, np.array([2, 9, 5]), np.array([1.0, 0.4, 2.5])
    bins = np.stack([rng.integers(0, b, n) for b in n_bins]).astype("u1")
    label, draws = rng.integers(0, 3, n).astype("i4"), rng.poisson(2, (1, n)).astype("u2")
    at = (bins[1] > 3).astype(int)      # the root has split on feature 1, both sides are open
    steps = {0: [(np.array([1]), np.array([3], dtype="u1"), np.array([0, 1]))]}
    subsets = {0: np.array([[2, 1], [0, 2]])}
    blocks = [pa.RecordBatch.from_pylist([{"n": m, "bins": np.ascontiguousarray(bins[:, s]).tobytes(), "label": label[s].tobytes(),
                                           "draws": np.ascontiguousarray(draws[:, s]).tobytes(), "width": 2}])
              for s, m in ((slice(0, 150), 150), (slice(150, n), n - 150))]
    counts = [pa.Table.from_batches(forest._counts(subsets, steps, n_bins, 3)(iter([b]))) for b in blocks]
    got = forest._splits(subsets, n_bins, weights)(pa.concat_tables(counts)).to_pylist()

    def gini(s):
        return 1 - ((s / s.sum()) ** 2).sum() if s.sum() else 0.0

    for node, s in enumerate(got):
        stats = lambda m: np.array([draws[0][m & (at == node) & (label == c)].sum() for c in range(3)])
        best = None
        for f in subsets[0][node]:
            for cut in range(n_bins[f] - 1):
                left, right = stats(bins[f] <= cut), stats(bins[f] > cut)
                if not left.sum() or not right.sum():
                    continue
                here = (left + right) * weights
                gain = gini(here) - ((left * weights).sum() * gini(left * weights) + (right * weights).sum() * gini(right * weights)) / here.sum()
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut, left.tolist(), (left + right).tolist())
        assert (s["feature"], s["cut"], s["left"], s["here"]) == best[1:] and abs(s["gain"] - best[0]) < 1e-9


def test_trees_are_met_by_cells_not_rows(spark, monkeypatch):
    """Rows alike in all bins and the label are one cell: fifty times the rows leave the work of a level as it is."""
    sizes, grow = [], forest.CellForest._grow

    def counted(self, blocks, n_bins, weights):
        sizes.append(blocks.agg(F.sum("n")).first()[0])
        return grow(self, blocks, n_bins, weights)

    monkeypatch.setattr(forest.CellForest, "_grow", counted)
    for copies in (1, 50):
        assert forest.CellForest(4, 3, 7, weight="w").fit(_frame(spark, 300, copies)).getNumTrees == 4
    assert sizes[0] == sizes[1] <= 300
    feats = diagnosis.diagnosis_features(Layers(spark, SF_SMALL).failed)
    scored = models.cross_fitted_diagnosis(feats, folds=2, num_trees=3, max_depth=2)
    assert len(sizes) == 4 and scored.count() == feats.count()      # both folds' forests were grown on cells


def test_draws_are_those_of_the_rows(spark):
    """A cell of n rows is drawn Poisson(n) times: mean and variance n, whatever the block."""
    cells = spark.createDataFrame([(bytes([i % 200, i // 200]), i % 3, 1 + i % 40) for i in range(2000)], "cell binary, label int, count long")
    blocks = cells.coalesce(1).mapInArrow(forest._blocks(2, 300, 5, 700), forest.BLOCK_SCHEMA).collect()
    assert [b.n for b in blocks] == [700, 700, 600]
    draws = np.concatenate([np.frombuffer(b.draws, f"u{b.width}").reshape(300, -1) for b in blocks], axis=1).astype(float)
    n = 1 + np.arange(2000) % 40
    assert np.abs(draws.mean(axis=0) / n - 1).max() < 0.35 and abs((draws.mean(axis=0) / n).mean() - 1) < 0.01
    assert abs((draws.var(axis=0) / n).mean() - 1) < 0.02
    assert not np.array_equal(draws[0], draws[1])


def test_same_forest_as_spark_ml_but_for_draws(spark):
    rows = _frame(spark, 3000).where("c is not null").persist()     # Spark ML's takes no row without a number
    mine = forest.CellForest(30, 6, 3, weight="w").fit(rows)
    theirs = RandomForestClassifier(numTrees=30, maxDepth=6, seed=3, weightCol="w").fit(rows)
    for m in (mine, theirs):
        scored = m.transform(rows)
        assert scored.where("prediction = label").count() >= 0.99 * rows.count()
        assert scored.where(F.abs(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
    a, b = mine.featureImportances.toArray(), theirs.featureImportances.toArray()
    assert np.abs(a - b).max() < 0.15
    assert (mine.numFeatures, mine.numClasses, len(mine.trees)) == (3, 3, 30) and all(t.depth <= 6 for t in mine.trees)
    again = forest.CellForest(30, 6, 3, weight="w").fit(rows)
    assert [t.toDebugString.split("\n")[1:] for t in again.trees] == [t.toDebugString.split("\n")[1:] for t in mine.trees]


def test_odd_tables(spark):
    one = _frame(spark, 300)
    same = one.where("label = 1")       # one class: every tree is a leaf
    fitted = forest.CellForest(3, 4, 1, weight="w").fit(same)
    assert fitted.totalNumNodes == 3 and fitted.transform(same).where("prediction = 1").count() == same.count()
    blank = VectorAssembler(inputCols=["z"], outputCol="features", handleInvalid="keep").transform(
        spark.range(40).select(F.lit(None).cast("double").alias("z"), (F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("w")))
    assert forest.CellForest(2, 4, 1, weight="w").fit(blank).totalNumNodes == 2    # nothing to split on
    with pytest.raises(ValueError, match="no rows"):
        forest.CellForest(2, 2, 1, weight="w").fit(one.limit(0))
    with pytest.raises(ValueError, match="more than one weight"):
        forest.CellForest(2, 2, 1, weight="w").fit(one.withColumn("w", F.rand(1)))
    assert [len(t) for t in forest.thresholds(one.select(vector_to_array("features").alias("x")), 32)] == [6, 4, 31]
