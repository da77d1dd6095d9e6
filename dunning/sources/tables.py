"""Table sources: driver parquet tables, CSV result tables, source contracts."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


#: Rows a task at most, for work that is heavy per row.
ROWS_PER_TASK = 50_000


class SourceContractError(ValueError):
    pass


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of a driver table; projections/filters applied later are
    pushed into the scan by Catalyst (ReadSchema / PushedFilters)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return df


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of a scan dealt evenly over tasks of ``rows_per_task`` rows at most, over all cores from two such tasks on: a
    scan has one task a file split, and compact files put millions of rows in one. The count reads file footers."""
    tasks = math.ceil(df.count() / rows_per_task)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism)) if tasks > 1 else df


def require_columns(df: DataFrame, required, table: str) -> DataFrame:
    """SRC-4: fail early, naming the first missing column."""
    have = set(df.columns)
    for c in required:
        if c not in have:
            raise SourceContractError(f"Missing column in {table}: {c}")
    return df


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows, schema: T.StructType | str) -> DataFrame:
    """A small fixed table as an inline VALUES relation (a LocalRelation in the
    JVM): no Python RDD, no job to broadcast it. For rule tables only."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]
    casts = ", ".join(f"CAST(col{i + 1} AS {f.dataType.simpleString()}) AS `{f.name}`"
                      for i, f in enumerate(schema.fields))
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
        return spark.sql(f"SELECT {nulls} WHERE FALSE")
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    df = spark.sql(f"SELECT {casts} FROM VALUES {values}")
    assert df.columns == names
    return df


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return literal_table(spark, [], schema)


def optional_table(spark: SparkSession, path: str | None, schema: T.StructType,
                   fmt: str = "parquet") -> DataFrame:
    """SRC-3: an absent table reads as an empty table of the declared schema,
    so the same left joins still run and yield typed NULL columns."""
    if not path or not _exists(spark, path):
        return empty_like(spark, schema)
    return read_result(spark, path, schema, fmt)


def read_result(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """SRC-1/2: read a result table with a declared schema (no inference)."""
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    if fmt == "json":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def with_typed_nulls(df: DataFrame, schema: T.StructType) -> DataFrame:
    """PRJ-3: add any column of ``schema`` missing from ``df`` as a typed NULL."""
    out = df
    for f in schema.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def union_all_columns(*dfs: DataFrame) -> DataFrame:
    """SET-2: union of differently shaped record sets; every column kept,
    missing ones NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
