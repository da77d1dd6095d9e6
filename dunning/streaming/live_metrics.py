"""AGG-6 kept up to date: KPIs of a stream of decisions and outcomes whose rows are replaced and withdrawn.

A change names a row by (kind, payment_id) and carries a version. The latest version counts:
keyed state holds each row as it counts now, and a change gives a signed row for what it
replaces (-1) and one for what it puts there (+1). Rows are dealt to ``BUCKETS`` buckets by hash
and a bucket's rows are one state value, so that calls into Python are one a bucket, not one a row;
the number of buckets belongs to the checkpoint. A micro-batch's signed rows are summed to one
row, published as a run of its epoch (an epoch tried again replaces itself), and the document is
the sum of the published rows: one small row an epoch, no decision is read again.

Defined results: a version not above the one that counts changes nothing, so repeated and late
rows are harmless; of one version in one micro-batch the first in the order of
(deleted, action, outcome, amounts) counts; a withdrawn row counts again when a later version puts it
back; rows without a payment id cannot be replaced, each counts unless it is a withdrawal; rows
without a version are older than any other; amounts travel as text, exact to the cent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dunning.operators import metrics
from dunning.sources import committed

DECISION, OUTCOME = "decision", "outcome"
CONTENT = ["action", "outcome", "amount", "recovered_amount"]
CHANGE_SCHEMA = ("kind string, payment_id string, version long, deleted boolean, action string, outcome string, "
                 "amount string, recovered_amount string")
SIGNED_SCHEMA = "kind string, action string, outcome string, amount string, recovered_amount string, sign long"
STATE_SCHEMA = ("kinds array<string>, payment_ids array<string>, versions array<long>, deleted array<boolean>, actions array<string>, "
                "outcomes array<string>, amounts array<string>, recovered_amounts array<string>")
BUCKETS, BUCKET = 4096, "__bucket"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OLDEST = -(1 << 63)


def changes(rows: DataFrame, kind: str, version: int, deleted: bool = False) -> DataFrame:
    """Change rows of decisions or outcomes as the batch layers give them."""
    content = [F.col(c).cast("string").alias(c) if c in rows.columns and not deleted else F.lit(None).cast("string").alias(c) for c in CONTENT]
    return rows.select(F.lit(kind).alias("kind"), "payment_id", F.lit(version).cast("long").alias("version"),
                       F.lit(deleted).alias("deleted"), *content)


def _order(row: tuple) -> tuple:
    return (-row[0], row[1], *[(v is not None, v or "") for v in row[2:]])


def _replace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Signed rows that lead from the rows of a bucket that counted to those that count now."""
    held: dict = {}
    if state.exists:
        kinds, ids, *columns = state.get
        held = dict(zip(zip(kinds, ids), zip(*columns)))
    now: dict = {}
    for batch in batches:
        given = batch[["kind", "payment_id", "version", "deleted", *CONTENT]].astype(object)
        for kind, pid, *row in given.where(given.notna(), None).itertuples(index=False, name=None):
            name, row = (kind, pid), (int(row[0]), bool(row[1]), *row[2:])
            old, new = held.get(name), now.get(name)
            if (old is None or row[0] > old[0]) and (new is None or _order(row) < _order(new)):
                now[name] = row
    if now:
        signed = [(name[0], *row[2:], sign) for name, new in now.items() for row, sign in ((held.get(name), -1), (new, 1))
                  if row is not None and not row[1]]
        held.update(now)
        state.update((*map(list, zip(*held)), *map(list, zip(*held.values()))))
        if signed:
            yield pd.DataFrame(signed, columns=["kind", *CONTENT, "sign"])


def signed_rows(feed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Signed rows of a streamed change feed."""
    clean = feed.withColumns({"version": F.coalesce("version", F.lit(OLDEST)), "deleted": F.coalesce("deleted", F.lit(False))})
    named = (clean.where(F.col("payment_id").isNotNull()).withColumn(BUCKET, F.pmod(F.xxhash64("kind", "payment_id"), F.lit(buckets)))
             .groupBy(BUCKET).applyInPandasWithState(_replace, SIGNED_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))
    nameless = clean.where(F.col("payment_id").isNull() & ~F.col("deleted")).select("kind", *CONTENT, F.lit(1).cast("long").alias("sign"))
    return named.union(nameless)


def signed_counts(signed: DataFrame) -> DataFrame:
    """One row of signed counts and sums, the inputs of ``metrics.kpi_document``."""
    def count(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("sign"))), F.lit(0))

    def total(column):
        return F.coalesce(F.sum(F.when(is_outcome, F.col(column).cast(metrics.MONEY) * F.col("sign").cast("decimal(3,0)"))),
                          F.lit(0)).cast(metrics.MONEY)

    is_decision, is_outcome = F.col("kind") == DECISION, F.col("kind") == OUTCOME
    action, outcome = F.col("action"), F.col("outcome")
    return signed.agg(
        count(is_decision).alias("records_evaluated"), count(is_decision).alias("policy_decisions"),
        *[count(is_decision & (action == a)).alias(n) for a, n in (("retry_now", "retry_now"), ("retry_later", "retry_later"),
                                                                   ("send_reminder", "send_reminder"), ("escalate_human", "human_escalations"))],
        count(is_outcome).alias("recovery_attempts"), count(is_outcome & (outcome == "recovered")).alias("successful_recoveries"),
        count(is_outcome & (outcome == "failed")).alias("failed_recoveries"),
        total("amount").alias("revenue_at_risk"), total("recovered_amount").alias("revenue_recovered"))


def start(spark: SparkSession, feed_dir: str, out_dir: str, checkpoint: str, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Parquet files of changes -> one published row of signed counts an epoch."""
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def publish(batch: DataFrame, epoch: int) -> None:
        committed.write_run(signed_counts(batch), out_dir, f"epoch-{epoch}")

    writer = signed_rows(reader.parquet(feed_dir)).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)  # rows that count stay out of the heap; a query keeps the settings it starts with
    try:
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
    finally:
        spark.conf.set(name, before)


def document(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The KPI row after the epochs published so far; None before the first."""
    rows = committed.read_runs(spark, out_dir)
    if rows is None:
        return None
    sums = [F.sum(c).cast(metrics.MONEY if c.startswith("revenue") else "long").alias(c) for c in rows.columns if c != "run"]
    return metrics.kpi_document(rows.agg(*sums))
