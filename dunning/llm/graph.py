"""Helpers: reliable lineage cuts and connected components of a link table."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FOREST_EDGES = 200_000  # edges of one spanning forest
TASK_EDGES = 50_000     # edges from which a step gets one task more than there are cores


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session may leave it unset (tests); a cluster must name a
    folder that the driver and all executors share.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="corpus-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so when the driver's garbage collection finds
    that no plan refers to them any more, which without a call may be long after the step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _forest(batches):
    """The edges (u, v) that join something new in a run of ``FOREST_EDGES`` edges: a spanning forest of each run."""
    parent: dict[int, int] = {}
    taken = 0

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        if taken > FOREST_EDGES:
            parent.clear()
            taken = 0
        taken += batch.num_rows
        keep = []
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            keep.append(a != b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        yield batch.filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``links`` (a, b): rows (node, root), root the
    smallest node of the component. Nodes without a link are absent; null ends
    and loops are ignored.

    First each task keeps a spanning forest of its own links, which connects the same nodes
    with fewer rows than nodes, whatever the number of links. Then alternating large-star and small-star steps: every node hangs its larger
    (smaller) neighbours on its smallest neighbour, until each component is one
    star. Minima are pre-aggregated, so a node with very many links costs one
    row per task; edges never leave the executors. Forests are far smaller than what the session's number of shuffle
    partitions is set for, so each step runs in as many tasks as its edges need: every task leaves files and log lines behind.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = ends.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    edges = cut(pairs.mapInArrow(_forest, "u long, v long").distinct())
    cores, state = links.sparkSession.sparkContext.defaultParallelism, None
    rows = edges.count()
    while True:
        tasks = max(cores, rows // TASK_EDGES + 1)
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
                 .distinct().coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least).coalesce(tasks).distinct().coalesce(tasks))
        edges = cut(small)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state, rows = tuple(seen), seen[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _free() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def freeing(work):
    """``work`` (a function of one group, of two cogrouped ones, or a generator over batches) which afterwards gives
    memory back to the system: the Python workers live on, and what each stage leaves in them would add up."""

    def over_batches(batches):
        try:
            yield from work(batches)
        finally:
            _free()

    def one(table):
        result = work(table)
        _free()
        return result

    def two(left, right):
        result = work(left, right)
        _free()
        return result

    if inspect.isgeneratorfunction(work):
        return over_batches
    return one if len(inspect.signature(work).parameters) == 1 else two
