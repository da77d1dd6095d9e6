"""Sinks (SNK-1, SNK-2, SNK-4, SNK-5).

All writes are distributed DataFrame writes; nothing is collected to the
driver except a one-row metrics document on request.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.functions.expr import nan_to_null
from dunning.sources import committed


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """SNK-1: overwrite a result table (Parquet by default; CSV with header)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def append_attempts(attempts: DataFrame, path: str, run_id: str) -> None:
    """SNK-2: every attempt of a run in one commit, partitioned by the execution day so
    later reads prune to the days they need; a run tried again replaces itself."""
    committed.write_run(attempts.withColumn("execution_date", F.substring("execution_timestamp", 1, 10)), path, run_id, ["execution_date"])


def read_attempts(spark: SparkSession, path: str) -> DataFrame | None:
    """The attempts of all published runs."""
    log = committed.read_runs(spark, path)
    return None if log is None else log.drop("run", "execution_date")


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """SNK-4: the one-row metrics document as a single JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def metrics_document(metrics: DataFrame) -> dict:
    """The metrics row as a Python dict (one row by construction)."""
    rows = metrics.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"metrics must be one row, got {len(rows)}")
    return json.loads(json.dumps(rows[0].asDict(), default=float))


def json_safe(df: DataFrame) -> DataFrame:
    """SNK-5: float columns with NaN / +-Inf become NULL."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(nan_to_null(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def records_with_count(df: DataFrame, folder: str) -> DataFrame:
    """SNK-5: a ``{count, data}`` listing, one row per record: its JSON text (NaN/Inf are
    NULL) and the number of records. The records are written to ``folder`` (shared) and counted
    there, which reads no column, so ``df`` is evaluated once. (An ``Observation`` would count
    while writing, but leaves the session unable to ship the closures of Spark ML models.)"""
    safe = json_safe(df)
    safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("record")).write.parquet(folder)
    written = df.sparkSession.read.parquet(folder)
    return written.select(F.lit(written.count()).cast("long").alias("count"), "record")


def read_metrics_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-5."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
