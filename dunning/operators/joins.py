"""Join and dedupe building blocks that stay balanced under key skew.

* ``first_per_key`` / ``latest_per_key`` (WIN-4/5/6) use an aggregate with
  ``min_by``/``max_by`` (a sort aggregate, as the values are structs) instead of ``row_number() OVER (PARTITION BY key)``:
  partial aggregation runs map-side, so a key holding a third of all rows
  is reduced to one row per map task before the shuffle.
* ``suffix_clashes`` (PRJ-4) renames right-side columns that clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick_per_key(df: DataFrame, key: str | list[str], order_by: list[str], fn) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order_by])
    picked = df.groupBy(*keys).agg(fn(F.struct(*[F.col(c) for c in rest]), ordering).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, key, order_by: list[str]) -> DataFrame:
    """Keep the first row per key by an explicit order (T7)."""
    return _pick_per_key(df, key, order_by, F.min_by)


def latest_per_key(df: DataFrame, key, order_by: list[str]) -> DataFrame:
    """Keep the last row per key by an explicit order."""
    return _pick_per_key(df, key, order_by, F.max_by)


def suffix_clashes(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    clash = (set(left.columns) & set(right.columns)) - set(on)
    return right.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in right.columns])


def override_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which a found right row overrides fields of the same name, nulls included (JON-10);
    ``right`` has at most one row per key."""
    clash = [c for c in right.columns if c in left.columns and c != key]
    hit = right.withColumn("__hit", F.lit(True)).withColumnsRenamed({c: f"__new_{c}" for c in clash})
    joined = left.join(hit, key, "left")
    own = [F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in clash else F.col(c) for c in left.columns]
    return joined.select(*own, *[c for c in right.columns if c not in left.columns])
