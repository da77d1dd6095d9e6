"""Appended runs that are visible whole or not at all (SNK-2).

A run writes its rows into a folder of its own, ``data/run=R/part=U``, and then
publishes it with one small manifest file, ``manifest/R.json``, put in place by an atomic
rename. Readers read the folders that manifests name and nothing else: a run that died
has no manifest and adds no rows; a run that is tried again publishes a new folder
under the same name, which replaces what it published before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST, DATA = "manifest", "data"


def _hadoop(spark: SparkSession, path: str):
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path, fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target, fs = _hadoop(spark, path)
    draft, _ = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(options, 1)
    replace[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, replace)


def write_run(rows: DataFrame, path: str, run_id: str, partition_by: list[str] | None = None) -> str:
    """Writes ``rows`` as run ``run_id`` and publishes them; returns the folder written."""
    if not run_id or "/" in run_id:
        raise ValueError("a run id must be a non-empty name without '/'")
    spark = rows.sparkSession
    folder = f"{DATA}/run={run_id}/part={uuid.uuid4().hex}"
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{folder}")
    _publish(spark, f"{path}/{MANIFEST}/{run_id}.json", json.dumps({"run": run_id, "folder": folder}))
    return folder


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each published run: a listing of one small file per run."""
    root, fs = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(root):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    files = [f"{path}/{MANIFEST}/{n}" for n in names if n.endswith(".json")]
    return {r["run"]: r["folder"] for r in spark.read.schema("run string, folder string").json(files).collect()} if files else {}


def read_runs(spark: SparkSession, path: str, run_ids: list[str] | None = None) -> DataFrame | None:
    """Rows of all published runs (or of some), with the column ``run``; None if there are none."""
    found = published(spark, path)
    folders = [f"{path}/{folder}" for run, folder in sorted(found.items()) if run_ids is None or run in run_ids]
    return spark.read.option("basePath", f"{path}/{DATA}").parquet(*folders).drop("part") if folders else None
