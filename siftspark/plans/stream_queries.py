"""Streaming queries, run to completion over a file stream of the event table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftspark.session import shared_dir
from siftspark.streaming.state import BLOCK_STATE, PIN_STATE, Step, block_step, counters, pin_step, run_with_state, tool_events, windowed_counts


#: Files of a micro-batch, which bounds what it reads.
FILES_A_BATCH = 16


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The event table as a stream of its files, and a folder of its own for what is written."""
    path = os.path.join(sf_dir, "events.parquet")
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", FILES_A_BATCH).parquet(path if os.path.isdir(path) else os.path.dirname(path) + "/events.parquet*")
    return tool_events(source), os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")


def _ended(running: StreamingQuery) -> None:
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def _with_state(spark: SparkSession, sf_dir: str, step: Step, schema: str, columns: str) -> DataFrame:
    events, at = _stream(spark, sf_dir)
    _ended(run_with_state(events, step, schema, at))
    return spark.read.schema(columns).parquet(f"{at}/out").select(*[c.split()[0] for c in columns.split(", ")])


def streaming_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_state(spark, sf_dir, block_step, BLOCK_STATE, "source string, event_id long, ts timestamp, blocked boolean")


def streaming_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_state(spark, sf_dir, pin_step, PIN_STATE, "source string, event_id long, ts timestamp, state string")


def streaming_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, at = _stream(spark, sf_dir)
    out = counters(events)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out")
    _ended(out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(out.schema).parquet(f"{at}/out").select(out.columns)


def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a stream that its watermark has closed, and, as a last batch ends it, all others."""
    events, at = _stream(spark, sf_dir)
    out = windowed_counts(events, late="3650 days")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
    _ended(out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema("source string, start timestamp, events long, batch int").parquet(f"{at}/out").groupBy("source", "start").agg(F.max_by("events", "batch").alias("events"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(tool_events(spark.read.parquet(os.path.join(sf_dir, "events.parquet"))))


QUERIES = {"streaming_blocklist": streaming_blocklist, "streaming_counters": streaming_counters, "streaming_pins": streaming_pins, "streaming_windows": streaming_windows, "windowed_events": windowed_events}
_EVENTS = "SELECT event_type AS source, event_id, ts, CASE WHEN value >= 95 THEN 3 WHEN value >= 50 THEN 1 ELSE 0 END AS level, CASE WHEN event_id % 997 = 0 THEN 'unblock' END AS control FROM events"
ORACLE = {
    "streaming_counters": f"SELECT source, count(*) AS events, count(*) FILTER (level = 3) AS critical, min(ts) AS first_seen, max(ts) AS last_seen FROM ({_EVENTS}) GROUP BY source",
    "streaming_blocklist": f"""WITH e AS ({_EVENTS}), marked AS (SELECT *, CASE WHEN control = 'unblock' THEN 0 WHEN level = 3 THEN 1 END AS turns FROM e),
state AS (SELECT *, last_value(turns IGNORE NULLS) OVER (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marked)
SELECT source, event_id, ts, coalesce(before, 0) = 1 AS blocked FROM state WHERE control IS NULL""",
    "streaming_pins": f"""WITH e AS (SELECT *, sha256(coalesce(props, '')) AS h FROM (SELECT event_type AS source, event_id, ts, props FROM events)), p AS (SELECT *, first_value(h) OVER w AS pin, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY source ORDER BY ts, event_id))
SELECT source, event_id, ts, CASE WHEN n = 1 THEN 'new' WHEN h = pin THEN 'known' ELSE 'changed' END AS state FROM p""",
    "windowed_events": f"SELECT source, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS events FROM ({_EVENTS}) GROUP BY ALL",
    "streaming_windows": f"SELECT source, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS events FROM ({_EVENTS}) GROUP BY ALL",
}
