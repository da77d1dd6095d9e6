"""Recovery log laid out for lookups (JON-8, SNK-3).

Rows lie under day=D/bucket=B/run=R/epoch=N: D is the day of the recovery, B a hash of the
event id. A micro-batch asks for its own ids only, so it reads the days from
``horizon_days`` before its first delivery on, and of these the buckets of its
ids: named folders, found without listing the rest of the log. The ids themselves
are then a semi join. ``horizon_days=None`` looks through all days.

A replayed epoch writes the same rows into the same folders (dynamic partition
overwrite), and never sees its own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
HORIZON_DAYS = 30


def bucket_of(event_id: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(buckets)).cast("int")


def write_epoch(recovered: DataFrame, log_dir: str, run: str, epoch: int, buckets: int = BUCKETS) -> None:
    """Adds the recoveries of one epoch; a second call with the same run and epoch replaces them."""
    rows = recovered.withColumns({"day": F.substring("recovered_at", 1, 10), "bucket": bucket_of("event_id", buckets),
                                  "run": F.lit(run), "epoch": F.lit(epoch)})
    (rows.repartition("day", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "bucket", "run", "epoch").parquet(log_dir))


def _folders(spark: SparkSession, log_dir: str, first_day: str | None, buckets: list[int]) -> list[str]:
    """Existing day=D/bucket=B folders with D from ``first_day`` on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(log_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    days = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("day=")]
    days = sorted(d for d in days if first_day is None or d[4:] >= first_day)
    found = []
    for day in days:
        have = {s.getPath().getName() for s in fs.listStatus(path(f"{log_dir}/{day}"))}
        found += [f"{log_dir}/{day}/bucket={b}" for b in buckets if f"bucket={b}" in have]
    return found


def processed_ids(spark: SparkSession, log_dir: str, batch: DataFrame, horizon_days: int | None = HORIZON_DAYS, exclude: tuple[str, int] | None = None,
                  buckets: int = BUCKETS, key: str = "__key", time: str = "received_at") -> DataFrame | None:
    """Ids of ``batch`` that the log holds within the horizon (column ``event_id``); None if no folder can hold one.

    One small aggregate of the batch gives its first day and its buckets (at most ``buckets`` numbers)."""
    asked = batch.agg(F.min(F.col(time)).alias("first"), F.collect_set(bucket_of(key, buckets)).alias("buckets")).first()
    first = asked["first"] and (asked["first"] - dt.timedelta(days=horizon_days)).strftime("%Y-%m-%d") if horizon_days is not None else None
    folders = _folders(spark, log_dir, first, sorted(asked["buckets"]))
    if not folders:
        return None
    log = spark.read.option("basePath", log_dir).parquet(*folders)
    if exclude is not None:
        log = log.where((F.col("run") != exclude[0]) | (F.col("epoch") != exclude[1]))
    return log.select("event_id").join(batch.select(F.col(key).alias("event_id")).distinct(), "event_id", "left_semi").distinct()
