"""Random forest over cells (ML-6 for many rows): the trees of Spark ML's forest, grown from counts.

Spark ML's forest meets every row in every tree on every level and keeps a draw per row and tree. Its trees
see of a row only the bins of its features (32 at most each), so rows with equal bins and label are alike
until the last level. ``CellForest`` therefore grows its trees on cells:

1. thresholds per feature: the midpoints of its values where there are up to ``max_bins``, else its quantiles;
2. rows are grouped by (bins, label): a cell and its number of rows, n;
3. a tree's bootstrap takes a cell Poisson(n) times, which is the sum of n draws of Poisson(1), one a row. Draws are
   made once and kept with the cells, in blocks of ``BLOCK`` cells;
4. level by level, a task adds up, tree by tree, the drawn rows per (node, feature, bin, label); counts of the tasks
   meet by (tree, ``NODES`` nodes) and give each node its best split (Gini on counts times class weight).

Features of a node (square root of their number), bins, weights, rule of a split, stop and the merge of equal leaves
are those of ``RandomForestClassifier``; only random draws differ. The trees go to Spark ML in the form
in which it saves them, so scores, importances and saving are its own.

Memory: a task holds its cells (``CELLS_PER_TASK``; draws take a byte or two a cell and tree) and the counts of one
level (a few MB per 10 trees); no cell passes through the driver, which holds trees and splits. Where no two rows are
alike there are as many cells as rows: the same job, without what the grouping saves.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.session import ensure_checkpoint_dir

CELLS_PER_TASK = 250_000
BLOCK = 16_384
NODES = 16
QUANTILE_ERROR = 0.001

BLOCK_SCHEMA = "n int, bins binary, label binary, draws binary, width int"
COUNT_SCHEMA = "tree int, chunk int, counts binary, width int"
SPLIT_SCHEMA = "tree int, node int, feature int, cut int, gain double, here array<double>, left array<double>"
NODE_SCHEMA = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double,"
               " leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")
_DOUBLES = pa.list_(pa.float64())
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", _DOUBLES), ("numCategories", pa.int32())])
NODE_COLUMNS = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", _DOUBLES), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT)]))])


class CellForest(Estimator):
    """Estimator of a ``RandomForestClassificationModel``; labels are whole numbers from 0, a class has one weight."""

    def __init__(self, num_trees: int, max_depth: int, seed: int, weight: str, features: str = "features",
                 label: str = "label", max_bins: int = 32):
        super().__init__()
        if not 2 <= max_bins <= 256:
            raise ValueError("max_bins must be 2 to 256: a bin is kept in one byte")
        self.num_trees, self.max_depth, self.seed, self.max_bins = num_trees, max_depth, seed, max_bins
        self.features, self.label, self.weight = features, label, weight

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark = dataset.sparkSession
        rows = dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("label"),
                              F.col(self.weight).alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            weights = class_weights(rows)
            cuts = thresholds(rows, self.max_bins)
            cells = rows.mapInArrow(_binned(cuts), "cell binary, label int").groupBy("cell", "label").count().persist(StorageLevel.MEMORY_AND_DISK)
            n_cells = cells.count()
        finally:
            rows.unpersist()
        tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(n_cells / CELLS_PER_TASK))
        size = max(1, min(BLOCK, math.ceil(n_cells / tasks)))
        blocks = (cells.repartition(tasks, "cell", "label").sortWithinPartitions("cell", "label")
                  .mapInArrow(_blocks(len(cuts), self.num_trees, self.seed, size), BLOCK_SCHEMA).persist(StorageLevel.MEMORY_AND_DISK))
        try:
            trees = self._grow(blocks, np.array([len(c) + 1 for c in cuts]), weights)
        finally:
            blocks.unpersist()
            cells.unpersist()
        return self._model(spark, trees, cuts, weights)

    def _grow(self, blocks: DataFrame, n_bins: np.ndarray, weights: np.ndarray) -> list[list[dict]]:
        """Nodes of every tree, the root first."""
        rng = np.random.default_rng(self.seed)
        n_features = len(n_bins)
        taken = n_features if self.num_trees == 1 else math.ceil(math.sqrt(n_features))
        trees: list[list[dict]] = [[{}] for _ in range(self.num_trees)]
        steps: list[list[tuple]] = [[] for _ in trees]     # per level: feature and cut of its open nodes, where their rows go
        open_nodes = {t: [0] for t in range(self.num_trees)}
        for level in range(self.max_depth):
            subsets = {t: np.argsort(rng.random((len(nodes), n_features)), axis=1)[:, :taken] for t, nodes in open_nodes.items()}
            counts = blocks.mapInArrow(_counts(subsets, {t: steps[t] for t in subsets}, n_bins, len(weights)), COUNT_SCHEMA)
            found = counts.groupBy("tree", "chunk").applyInArrow(_splits(subsets, n_bins, weights), SPLIT_SCHEMA).collect()
            by_tree: dict[int, list] = {t: [None] * len(nodes) for t, nodes in open_nodes.items()}
            for s in found:
                by_tree[s.tree][s.node] = s
            following = {}
            for t, splits in by_tree.items():
                nodes, new, goes = trees[t], [], np.full(2 * len(splits), -1, dtype="i8")
                for k, s in enumerate(splits):
                    here = nodes[open_nodes[t][k]]
                    if s is None:    # no draw reached the tree
                        here.setdefault("counts", np.zeros(len(weights)))
                        continue
                    here["counts"] = np.array(s.here)
                    if s.feature < 0:
                        continue
                    left = np.array(s.left)
                    here.update(feature=s.feature, cut=s.cut, gain=s.gain, left=len(nodes), right=len(nodes) + 1)
                    for side, part in enumerate((left, here["counts"] - left)):
                        if level + 1 < self.max_depth and np.count_nonzero(part) > 1:
                            goes[2 * k + side] = len(new)
                            new.append(len(nodes))
                        nodes.append({"counts": part})
                steps[t].append((np.array([0 if s is None else max(s.feature, 0) for s in splits]),
                                 np.array([0 if s is None else s.cut for s in splits], dtype="u1"), goes))
                if new:
                    following[t] = new
            open_nodes = following
            if not open_nodes:
                break
        return trees

    def _model(self, spark: SparkSession, trees: list[list[dict]], cuts: list[np.ndarray], weights: np.ndarray) -> RandomForestClassificationModel:
        """The trees, written as Spark ML saves a forest and loaded by it."""
        shared = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": {},
                  "numFeatures": len(cuts), "numClasses": len(weights)}
        params = {"featuresCol": self.features, "labelCol": self.label, "weightCol": self.weight, "maxDepth": self.max_depth,
                  "maxBins": self.max_bins, "impurity": "gini", "seed": self.seed}
        kind = "org.apache.spark.ml.classification."
        forest = shared | {"class": kind + "RandomForestClassificationModel", "uid": self.uid, "numTrees": len(trees),
                           "paramMap": params | {"numTrees": len(trees)}}
        one = [json.dumps(shared | {"class": kind + "DecisionTreeClassificationModel", "uid": f"{self.uid}_{t}", "paramMap": params})
               for t in range(len(trees))]
        # tree by tree into columns: nodes as Python objects take far more room
        nodes = pa.concat_tables([pa.Table.from_pylist([{"treeID": t, "nodeData": n} for n in _preorder(tree, cuts, weights)], NODE_COLUMNS)
                                  for t, tree in enumerate(trees)])
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
        spark.createDataFrame([(json.dumps(forest),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
        spark.createDataFrame([(t, m, 1.0) for t, m in enumerate(one)], "treeID int, metadata string, weights double").coalesce(1).write.parquet(
            f"{folder}/treesMetadata")
        spark.createDataFrame(nodes, NODE_SCHEMA).coalesce(1).write.parquet(f"{folder}/data")
        model = RandomForestClassificationModel.load(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return model


def class_weights(rows: DataFrame) -> np.ndarray:
    """Weight of every class, 0 for one that has no rows."""
    found = rows.groupBy("label").agg(F.min("w").alias("low"), F.max("w").alias("high")).collect()
    if not found:
        raise ValueError("no rows to fit a forest on")
    out = np.zeros(max(r.label for r in found) + 1)
    for r in found:
        if r.low != r.high:
            raise ValueError(f"class {r.label} has more than one weight")
        out[r.label] = r.low
    return out


def thresholds(rows: DataFrame, max_bins: int) -> list[np.ndarray]:
    """Per feature of ``x`` the rising values t of its tests x <= t, ``max_bins`` - 1 at most; NaN (a null number) is above all."""
    n = rows.select(F.size("x")).first()[0]
    found = (rows.select("x").mapInArrow(_values(max_bins), "feature int, value double").distinct()
             .groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("values"), F.bool_or(F.col("value").isNull()).alias("more"))
             .collect())     # max_bins + 1 values a feature and task at most
    few = {r.feature: np.array(r.values) for r in found if not r.more and len(r.values) <= max_bins}
    many = [r.feature for r in found if r.feature not in few]
    x = rows.select(*[F.nanvl(F.get("x", F.lit(i)), F.lit(None).cast("double")).alias(str(i)) for i in many])
    marks = x.approxQuantile(x.columns, [i / max_bins for i in range(1, max_bins)] + [1.0], QUANTILE_ERROR) if many else []
    out = {i: (v[:-1] + v[1:]) / 2 for i, v in few.items()}
    out |= {i: np.array(sorted({v for v in m[:-1] if v < m[-1]})) for i, m in zip(many, marks)}
    return [out.get(i, np.empty(0)) for i in range(n)]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _values(most: int):
    """Per feature the values of a task (NaN is none of them); where there are more than ``most``, a null besides."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for i, column in enumerate(_matrix(batch).T):
                    if len(seen.setdefault(i, np.empty(0))) <= most:
                        seen[i] = np.unique(np.concatenate([seen[i], column[~np.isnan(column)]]))[:most + 1]
        for i, v in seen.items():
            listed = v.tolist() + [None] * (len(v) > most)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(listed), pa.int32()), pa.array(listed, pa.float64())], names=["feature", "value"])

    return run


def _binned(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            bins = np.empty(x.shape, dtype="u1")
            for i, c in enumerate(cuts):
                bins[:, i] = np.searchsorted(c, x[:, i])
            cell = pa.Array.from_buffers(pa.binary(len(cuts)), batch.num_rows, [None, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([cell.cast(pa.binary()), batch.column("label")], names=["cell", "label"])

    return run


def _blocks(n_features: int, num_trees: int, seed: int, size: int):
    """Sorted cells of a task to blocks: bins by feature, labels, and the draws of every tree."""

    def run(batches: Iterator[pa.RecordBatch]):
        batches = [b for b in batches if b.num_rows]
        cells = pa.Table.from_batches(batches) if batches else []
        for k, start in enumerate(range(0, len(cells), size)):
            part = cells.slice(start, size)
            bins = np.frombuffer(b"".join(part.column("cell").to_pylist()), dtype="u1").reshape(-1, n_features)
            rng = np.random.default_rng([seed, TaskContext.get().partitionId(), k])
            draws = rng.poisson(part.column("count").to_numpy(), size=(num_trees, len(part)))
            draws = draws.astype(np.min_scalar_type(int(draws.max())))
            yield pa.RecordBatch.from_pylist([{"n": len(part), "bins": np.ascontiguousarray(bins.T).tobytes(), "width": draws.itemsize,
                                               "label": part.column("label").to_numpy().astype("i4").tobytes(), "draws": draws.tobytes()}],
                                             schema=pa.schema([("n", pa.int32()), ("bins", pa.binary()), ("label", pa.binary()),
                                                               ("draws", pa.binary()), ("width", pa.int32())]))

    return run


def _offsets(subset: np.ndarray, n_bins: np.ndarray, n_classes: int) -> np.ndarray:
    """Where the counts of each (node, feature) start, in rising order, and their end."""
    return np.concatenate([[0], np.cumsum(n_bins[subset].ravel() * n_classes)])


def _counts(subsets: dict, steps: dict, n_bins: np.ndarray, n_classes: int):
    """Drawn rows per (open node, feature of its subset, bin, label) of a task's blocks, one tree after another, so that the counts
    of a tree stay in a core's cache."""

    def run(batches: Iterator[pa.RecordBatch]):
        offsets = {t: _offsets(s, n_bins, n_classes) for t, s in subsets.items()}
        starts = {t: o[:-1].reshape(subsets[t].shape) for t, o in offsets.items()}
        counts = {t: np.zeros(o[-1]) for t, o in offsets.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                n, width = batch.column("n")[i].as_py(), batch.column("width")[i].as_py()
                bins = np.frombuffer(batch.column("bins")[i].as_buffer(), dtype="u1")
                label = np.frombuffer(batch.column("label")[i].as_buffer(), dtype="i4")
                codes = (bins.reshape(-1, n) * np.int64(n_classes) + label).astype(np.min_scalar_type(int(n_bins.max()) * n_classes)).ravel()
                draws = np.frombuffer(batch.column("draws")[i].as_buffer(), dtype=f"u{width}").reshape(-1, n)
                for t in subsets:
                    cell = np.flatnonzero(draws[t])
                    at = np.zeros(len(cell), dtype="i8")
                    for feature, cut, goes in steps[t]:
                        spot = (feature * n).take(at)
                        spot += cell
                        right = bins.take(spot) > cut.take(at)
                        at *= 2
                        at += right
                        at = goes.take(at)
                        if len(at) and at.min() < 0:
                            stays = np.flatnonzero(at >= 0)
                            at, cell = at.take(stays), cell.take(stays)
                    spot = (subsets[t] * n).take(at, axis=0)
                    spot += cell[:, None]
                    slot = starts[t].take(at, axis=0)
                    slot += codes.take(spot)
                    drawn = np.repeat(draws[t].take(cell).astype("f8"), slot.shape[1])
                    counts[t] += np.bincount(slot.ravel(), weights=drawn, minlength=len(counts[t]))
        for t, o in offsets.items():
            width = 4 if counts[t].max(initial=0) < 2**31 else 8
            edges = [*range(0, len(subsets[t]), NODES), len(subsets[t])]
            ends = o[::subsets[t].shape[1]]
            parts = [counts[t][ends[a]:ends[b]].astype(f"i{width}").tobytes() for a, b in zip(edges, edges[1:])]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([t] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary()),
                                              pa.array([width] * k, pa.int32())], names=["tree", "chunk", "counts", "width"])

    return run


def _gini(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and Gini impurity over the last axis (0 for none)."""
    total = stats.sum(axis=-1)
    share = stats / np.where(total > 0, total, 1)[..., None]
    return total, np.where(total > 0, 1 - (share * share).sum(axis=-1), 0)


def _splits(subsets: dict, n_bins: np.ndarray, weights: np.ndarray):
    """The best split of each node of a chunk: largest gain, then first feature of its subset, then lowest cut; feature -1 for none."""

    def run(table: pa.Table) -> pa.Table:
        t, chunk, c = table.column("tree")[0].as_py(), table.column("chunk")[0].as_py(), len(weights)
        subset = subsets[t][chunk * NODES:(chunk + 1) * NODES]
        k, m = subset.shape
        flat = sum(np.frombuffer(v.as_buffer(), dtype=f"i{w.as_py()}").astype("i8") for v, w in zip(table.column("counts"), table.column("width")))
        held = n_bins[subset].ravel()
        upto = np.zeros((k * m, int(n_bins.max()), c))
        upto[np.arange(upto.shape[1]) < held[:, None]] = flat.reshape(-1, c)
        upto = upto.cumsum(axis=1)
        here, left = upto[:, -1], upto[:, :-1]
        right = here[:, None] - left
        total, impurity = _gini(here * weights)
        (w_left, i_left), (w_right, i_right) = _gini(left * weights), _gini(right * weights)
        gain = impurity[:, None] - (w_left * i_left + w_right * i_right) / np.where(total > 0, total, 1)[:, None]
        gain[(left.sum(axis=-1) < 1) | (right.sum(axis=-1) < 1)] = -1
        gain = gain.reshape(k, -1)
        if gain.shape[1]:
            best = gain.argmax(axis=1)
            gains = gain[np.arange(k), best]
            slot, cut = np.divmod(best, upto.shape[1] - 1)
        else:   # no feature has two bins
            gains, slot, cut = np.full(k, -1.0), np.zeros(k, dtype="i8"), np.zeros(k, dtype="i8")
        at = np.arange(k) * m + slot
        feature = np.where(gains > 0, subset[np.arange(k), slot], -1)
        return pa.table({"tree": pa.array([t] * k, pa.int32()), "node": pa.array(chunk * NODES + np.arange(k), pa.int32()),
                         "feature": pa.array(feature, pa.int32()), "cut": pa.array(cut, pa.int32()), "gain": pa.array(gains, pa.float64()),
                         "here": pa.array(list(here[at]), pa.list_(pa.float64())),
                         "left": pa.array(list(upto[at, cut]), pa.list_(pa.float64()))})

    return run


def _preorder(nodes: list[dict], cuts: list[np.ndarray], weights: np.ndarray) -> list[dict]:
    """Nodes as Spark ML numbers and saves them. Two leaves of one class are merged into their parent, as it does."""
    out: list[dict] = []

    def leaf(row: dict) -> bool:
        return row["leftChild"] < 0

    def put(n: dict) -> None:
        stats = n["counts"] * weights
        row = {"id": len(out), "prediction": float(stats.argmax()), "impurity": float(_gini(stats)[1]), "impurityStats": stats.tolist(),
               "rawCount": int(n["counts"].sum()), "gain": -1.0, "leftChild": -1, "rightChild": -1,
               "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        out.append(row)
        if "left" not in n:
            return
        left = len(out)
        put(nodes[n["left"]])
        right = len(out)
        put(nodes[n["right"]])
        if leaf(out[left]) and leaf(out[right]) and out[left]["prediction"] == out[right]["prediction"]:
            del out[left:]
            return
        row.update(gain=n["gain"], leftChild=left, rightChild=right,
                   split={"featureIndex": n["feature"], "leftCategoriesOrThreshold": [float(cuts[n["feature"]][n["cut"]])], "numCategories": -1})

    put(nodes[0])
    return out
