"""Keyed state over a stream of tool events: block list, first-seen pins, counters and windows.

A micro-batch is judged by DataFrame operations against the state before it, and leaves the state after it as a table of its own
number, so a batch that is run again after a failure reads what it read the first time. A key with any share of the rows is cut
by hours: what happens within an hour is a window of its own, and hours are joined by one row each.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BLOCK_STATE, PIN_STATE = "source string, blocked boolean", "source string, pin string"

#: From a batch and the state before it, the rows to put out and the state after it.
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def block_step(events: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each event (source, event_id, ts, level, control) but unblocking ones whether its source was blocked when it came: source, event_id, ts, blocked.

    A source with a critical event, or an order to block it, is blocked from the next event on, until an operator unblocks it.
    """
    turn = F.when(F.col("control") == "unblock", 0).when((F.col("level") == 3) | (F.col("control") == "block"), 1)
    marked = events.select("source", "event_id", "ts", "control", turn.alias("turn"), F.date_trunc("hour", "ts").alias("hour"))
    place = F.struct("ts", "event_id")
    within = Window.partitionBy("source", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    hours = marked.groupBy("source", "hour").agg(F.max_by("turn", F.when(F.col("turn").isNotNull(), place)).alias("turn"))
    before = Window.partitionBy("source").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select("source", "hour", F.last("turn", ignorenulls=True).over(before).alias("carried"))
    known = state.select("source", F.col("blocked").cast("int").alias("stored"))
    judged = marked.withColumn("own", F.last("turn", ignorenulls=True).over(within)).join(carried, ["source", "hour"], "left").join(known, "source", "left")
    rows = judged.where(F.coalesce("control", F.lit("")) != "unblock").select("source", "event_id", "ts", (F.coalesce("own", "carried", "stored", F.lit(0)) == 1).alias("blocked"))
    final = hours.where(F.col("turn").isNotNull()).groupBy("source").agg((F.max_by("turn", "hour") == 1).alias("now"))
    after = state.join(final, "source", "full").select("source", F.coalesce("now", "blocked").alias("blocked"))
    return rows, after


def pin_step(events: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each event with a hash new, known or changed against the first one of its source: source, event_id, ts, state. The first hash is the pin for ever."""
    hashed = events.where(F.col("hash").isNotNull())
    first = hashed.groupBy("source").agg(F.min_by(F.struct("hash", "event_id"), F.struct("ts", "event_id")).alias("first"))
    pins = first.join(state, "source", "full").select("source", F.coalesce("pin", "first.hash").alias("pin"), F.when(F.col("pin").isNull(), F.col("first.event_id")).alias("__new"))
    seen = hashed.join(pins, "source").select("source", "event_id", "ts", F.when(F.col("event_id") == F.col("__new"), "new").when(F.col("hash") == F.col("pin"), "known").otherwise("changed").alias("state"))
    return seen, pins.select("source", "pin")


def run_with_state(events: DataFrame, step: Step, schema: str, root: str) -> StreamingQuery:
    """The stream of ``events`` through ``step``: rows under ``root``/out, state under ``root``/state, both by batch number; a batch that is run again overwrites its own."""
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        at = f"{root}/state/batch={number - 1}"
        before = spark.read.schema(schema).parquet(at) if number else spark.createDataFrame([], schema)
        rows, after = step(batch, before)
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        after.write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start()


def counters(events: DataFrame) -> DataFrame:
    """Running counts by source: documents, critical, first and last time."""
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == 3).alias("critical"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; events later than the watermark are left out (of streams; batches have none)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "source").agg(F.count(F.lit(1)).alias("events")).select("source", F.col("window.start").alias("start"), "events")


def tool_events(raw: DataFrame) -> DataFrame:
    """The event table as tool events: its type is the source, high values are critical."""
    return raw.select(
        F.col("event_type").alias("source"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("value") >= 95, 3).when(F.col("value") >= 50, 1).otherwise(0).alias("level"),
        F.when(F.col("event_id") % 997 == 0, "unblock").alias("control"),
        F.sha2(F.coalesce("props", F.lit("")), 256).alias("hash"),
    )
