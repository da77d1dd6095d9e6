"""STR-3 with bounded, exact state: every delivery gets a status, ids are forgotten after a window.

The first delivery of an event id that would be a recovery opens a window of ``window``
seconds of event time; deliveries of that id inside it are ``already_processed``; the
first that would be a recovery after it opens a new one. Ids are dealt to ``BUCKETS`` buckets by
hash; the keyed state value of a bucket holds, per open id, the time of the winning delivery and
the time to forget it, the window plus ``slack`` after its file landed, so state is bounded by the
ids of one window. A bucket's timer stands at the earliest of those times: calls into Python and
to the state store are one set a bucket, not one an id. The number of buckets belongs to the
checkpoint: a query goes on with the number it started with.
Whether a delivery is inside a window is decided by event times alone, the timer only
forgets. The watermark follows the landing times of files, which the source reads in
order, so no delivery is dropped for an old event time; ``slack`` covers files
that land out of order and deliveries that land late.

Rejected deliveries never touch the state. Of one micro-batch, the rows of one id are ordered
by (received_at, delivery_id) in their bucket's call; ``max_files_per_trigger`` bounds a micro-batch.
Checkpointed state makes a restart go on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dunning.streaming import webhook as W

WINDOW_SECONDS = 30 * 86_400
SLACK_SECONDS = 2 * 86_400
BUCKETS = 4096
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LANDED, BUCKET = "__landed", "__bucket"
_CARRIED = ["delivery_id", "received_at", "__guard", "event", "__has_entity", "payment_link_id", "payment_id", "amount", "currency",
            "reference_id", "__key", "__amount_ok", "__would_recover"]


class FirstInWindow(StatefulProcessor):
    """Adds ``__dup``: whether the delivery lies in a window that another delivery of its id opened."""

    def __init__(self, window_seconds: int, slack_seconds: int):
        self.window_us = window_seconds * 1_000_000
        self.kept_ms = (window_seconds + slack_seconds) * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "timer_ms long, ids array<string>, received_us array<long>, forget_ms array<long>")

    def _open(self) -> tuple[int | None, dict]:
        """The bucket's timer and its open ids: id -> (time of the winning delivery, time to forget it)."""
        if not self.first.exists():
            return None, {}
        timer, ids, received, forget = self.first.get()
        return timer, dict(zip(ids, zip(received, forget)))

    def _keep(self, timer: int | None, held: dict) -> None:
        """Writes the open ids; the timer stands at the earliest time to forget one, or before it."""
        if not held:
            self.first.clear()
            return
        earliest = min(forget for _, forget in held.values())
        if timer is None or earliest < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
            timer = earliest
        received, forget = zip(*held.values())
        self.first.update((timer, list(held), list(received), list(forget)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).set_axis([*_CARRIED, LANDED, BUCKET], axis=1)  # names with underscores arrive renamed
        batch = batch.sort_values(["received_at", "delivery_id"], kind="stable", na_position="first")
        accepted = batch["__guard"].isna().to_numpy()  # rejected deliveries have keys of their own and no state
        dup = [False] * len(batch)
        if accepted.any():
            timer, held = self._open()
            changed = set()
            times = batch["received_at"].astype("datetime64[us]").astype("int64").tolist()
            for k, (ok, name, opens, at) in enumerate(zip(accepted.tolist(), batch["__key"].tolist(), batch["__would_recover"].tolist(), times)):
                if ok:
                    dup[k] = name in held and at < held[name][0] + self.window_us
                    if opens and not dup[k]:
                        held[name] = (at, None)
                        changed.add(name)
            if changed:
                landed = batch[accepted].groupby("__key")[LANDED].max()
                for name in changed:
                    held[name] = (held[name][0], int(landed[name].timestamp() * 1_000) + self.kept_ms)
                self._keep(timer, held)
        yield batch.drop(columns=[LANDED, BUCKET]).assign(**{"__dup": dup})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._open()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self._keep(None, {name: v for name, v in held.items() if v[1] > passed})
        return iter(())

    def close(self) -> None:
        pass


def classified_stream(deliveries: DataFrame, secret: str, window_seconds: int = WINDOW_SECONDS, slack_seconds: int = SLACK_SECONDS,
                      buckets: int = BUCKETS) -> DataFrame:
    """Status per delivery of a file stream of envelopes; the columns of ``webhook.classify``."""
    landed = deliveries.withColumn(LANDED, F.col("_metadata.file_modification_time"))
    guarded = W.guard_stage(landed, secret, keep=[LANDED]).select(*_CARRIED, LANDED).withWatermark(LANDED, f"{slack_seconds} seconds")
    dealt = guarded.withColumn(BUCKET, F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    schema = T.StructType([*guarded.drop(LANDED).schema.fields, T.StructField("__dup", T.BooleanType())])
    return W.with_status(dealt.groupBy(BUCKET).transformWithStateInPandas(
        FirstInWindow(window_seconds, slack_seconds), schema, "Append", "EventTime"), F.col("__dup"))


def start_bounded_stream(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint: str, secret: str,
                         window_seconds: int = WINDOW_SECONDS, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Landing JSON files -> one status row per delivery (Parquet, exactly once by the file sink's log)."""
    reader = spark.readStream.schema(W.ENVELOPE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = classified_stream(reader.json(landing_dir), secret, window_seconds)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)  # keyed state with timers needs it; a query keeps the settings it starts with
    try:
        w = out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append")
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    finally:
        spark.conf.set(name, before)
