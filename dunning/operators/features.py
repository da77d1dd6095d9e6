"""Per-customer history features (WIN-1..3, ML-1, ML-2).

"How many earlier rows does this customer have" is a running count over a
customer's time-ordered rows. A plain window ``PARTITION BY customer`` puts
every row of a customer into one task, so one customer holding a third of
all payments would serialise a third of the job. ``prior_totals`` is a parallel
scan instead:

1. the rows are range partitioned and sorted by (key, order), so a hot key, even a
   hot hour of it, is cut wherever a partition is full;
2. each task runs once over its sorted rows and adds up per key (Arrow batches with
   a carry of one key); rows go to a checkpoint, which fixes where the cuts are;
3. totals per (partition, key) are prefix-summed over a key's partitions. Only a key
   that goes on from one partition to the next carries anything: fewer rows than
   partitions, broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.session import ensure_checkpoint_dir



def _starts(keys: pa.Array) -> np.ndarray:
    """Positions where a new key starts in a sorted column; nulls are one key."""
    after, before = keys.slice(1), keys.slice(0, max(0, len(keys) - 1))
    new = pc.or_(pc.fill_null(pc.not_equal(after, before), False), pc.not_equal(pc.is_null(after), pc.is_null(before)))
    return np.concatenate([[0], np.nonzero(new.to_numpy(zero_copy_only=False))[0] + 1])


def _scan(key: str, sums: list[str]):
    """Turns the columns ``sums`` of sorted rows into the sums over earlier rows of the same key in the task."""

    def run(batches):
        carry, last = np.zeros(len(sums), dtype="i8"), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            starts = _starts(keys)
            length = np.diff(np.append(starts, len(keys)))
            goes_on = last is not None and last[0] == keys[0].as_py()
            columns = {name: batch.column(name) for name in batch.schema.names}
            for k, name in enumerate(sums):
                value = columns[name].to_numpy(zero_copy_only=False)
                before = np.cumsum(value) - value
                base = before[starts]
                if goes_on:
                    base[0] -= carry[k]
                prior = before - np.repeat(base, length)
                columns[name] = pa.array(prior)
                carry[k] = prior[-1] + value[-1]
            last = (keys[-1].as_py(),)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def prior_totals(df: DataFrame, key: str, order_by: list[str], values: dict[str, Column]) -> DataFrame:
    """Add, per row, the sum of each ``values`` column (whole numbers, null counts 0) over the
    rows of the same ``key`` that come strictly earlier in ``order_by`` order (0 if none).

    No row is lost: a null key is a key of its own, and nulls of ``order_by``
    come last. Rows equal in key and order stand in any order. Keys are not
    floating-point numbers. Runs the scan when called (it writes a checkpoint)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    own, sums = [f"__v_{n}" for n in values], [f"__in_{n}" for n in values]
    order = [F.col(key).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order_by]]
    src = df.select("*", *[F.coalesce(v.cast("long"), F.lit(0)).alias(o) for v, o in zip(values.values(), own)])
    ranged = (src.select("*", *[F.col(o).alias(i) for o, i in zip(own, sums)]).repartitionByRange(*order).sortWithinPartitions(*order))
    scanned = ranged.mapInArrow(_scan(key, sums), ranged.schema).withColumn("__part", F.spark_partition_id()).checkpoint()

    totals = scanned.groupBy(F.col(key).alias("__ok"), F.col("__part").alias("__op")).agg(*[F.sum(o).alias(o) for o in own])
    earlier = Window.partitionBy("__ok").orderBy("__op").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.select("__ok", "__op", F.count(F.lit(1)).over(earlier).alias("__n"),
                             *[F.sum(o).over(earlier).alias(f"__off_{n}") for o, n in zip(own, values)])
               .where(F.col("__n") > 0).drop("__n"))  # a key that goes on: one a partition at most
    out = scanned.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("__ok")) & (F.col("__part") == F.col("__op")), "left")
    return out.select(*df.columns, *[(F.coalesce(F.col(f"__off_{n}"), F.lit(0)) + F.col(i)).alias(n) for n, i in zip(values, sums)])


def with_time_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """FN-2/FN-3: hour of day and weekday with Monday = 0."""
    return (df.withColumn("hour_of_day", F.hour(ts))
              .withColumn("day_of_week", F.weekday(ts)))


def customer_fail_history(failed: DataFrame) -> DataFrame:
    """WIN-1 / ML-1: diagnosis feature table over failed payments.

    customer_fail_count = earlier failures of the same customer (time, then id
    order), 0 for the first."""
    out = prior_totals(failed, "customer_id", ["timestamp", "payment_id"],
                       {"customer_fail_count": F.lit(1)})
    return with_time_parts(out)


def customer_risk_features(pay: DataFrame) -> DataFrame:
    """WIN-2/3 / ML-2: detection features over all payments.

    customer_txn_count_so_far = earlier payments of the customer;
    customer_prior_fail_rate = earlier failures / earlier payments (0 without history);
    actual_at_risk = 1 for a failed payment."""
    is_failed = (F.col("status") == "failed").cast("int")
    out = prior_totals(pay, "customer_id", ["timestamp", "payment_id"],
                       {"customer_txn_count_so_far": F.lit(1), "__prior_fails": is_failed})
    out = with_time_parts(out)
    rate = F.when(F.col("customer_txn_count_so_far") > 0,
                  F.col("__prior_fails") / F.col("customer_txn_count_so_far")).otherwise(F.lit(0.0))
    return (out.withColumn("customer_prior_fail_rate", rate)
               .withColumn("actual_at_risk", is_failed)
               .drop("__prior_fails"))


def customer_odds(pay: DataFrame) -> DataFrame:
    """Failed and paid payments of every customer and the odds of failure, failed / paid
    (infinite without a paid one; rows of no customer are one group)."""
    counts = pay.groupBy("customer_id").agg(F.count_if(F.col("status") == "failed").alias("failed"),
                                            F.count_if(F.col("status") != "failed").alias("paid"))
    odds = F.col("failed") * F.pow(F.col("paid").cast("double"), F.lit(-1.0))
    return counts.withColumn("odds", F.round(odds, 6))
