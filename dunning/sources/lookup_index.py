"""Tables laid out for point lookups (FLT-5).

Rows lie in hash buckets of their key, sorted by it, with a Parquet Bloom filter on the key.
A lookup names one bucket folder (partition pruning), skips the row groups whose
statistics or filter exclude the key, and reads nothing else; a list of ids is a
join that prunes to the buckets of its ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
COLUMN = "__bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Overwrites ``path`` with ``rows``; any number of rows may share a key, null keys are found by no lookup."""
    placed = rows.withColumn(COLUMN, _bucket(F.col(key), buckets))
    (placed.repartition(COLUMN).sortWithinPartitions(COLUMN, key).write.mode("overwrite").partitionBy(COLUMN)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def find(spark: SparkSession, path: str, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one key; the plan reads one bucket."""
    typed = F.lit(value).cast(dict(spark.read.parquet(path).dtypes)[key])
    return spark.read.parquet(path).where((F.col(COLUMN) == _bucket(typed, buckets)) & (F.col(key) == typed)).drop(COLUMN)


def find_all(spark: SparkSession, path: str, key: str, asked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of all keys in the column ``key`` of ``asked``, each asked key once."""
    keys = asked.select(key).distinct().withColumn(COLUMN, _bucket(F.col(key), buckets))
    return spark.read.parquet(path).join(keys, [COLUMN, key]).drop(COLUMN)
