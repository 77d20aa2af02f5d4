"""State over several micro-batches against brute force, and late events."""

import random
from datetime import datetime, timedelta

import pytest

from siftspark.streaming.state import BLOCK_STATE, PIN_STATE, block_step, pin_step, run_with_state, windowed_counts

SCHEMA = "source string, event_id long, ts timestamp, level int, control string, hash string"
START = datetime(2024, 1, 1)


def batches(seed):
    r = random.Random(seed)
    out, n = [], 0
    for b in range(3):
        rows = []
        for _ in range(60):
            n += 1
            rows.append((r.choice("abc") if r.random() < 0.6 else "hot", n, START + timedelta(days=b, minutes=r.randrange(600)), r.choice([0, 1, 1, 3]) if r.random() < 0.3 else 0, r.choice([None] * 8 + ["unblock", "block"]), r.choice([None, "h1", "h2"])))
        out.append(rows)
    return out


def streamed(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == len(parts)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("seed", [1, 2])
def test_block_list_over_batches(spark, tmp_path, seed):
    parts = batches(seed)
    q = run_with_state(streamed(spark, tmp_path, parts), block_step, BLOCK_STATE, "file://" + str(tmp_path / "run"))
    q.awaitTermination()
    got = {(r.source, r.event_id): r.blocked for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()}
    state, want = {}, {}
    for rows in parts:
        for source, n, _, level, control, _ in sorted(rows, key=lambda x: (x[2], x[1])):
            if control == "unblock":
                state[source] = False
                continue
            want[source, n] = state.get(source, False)
            if level == 3 or control == "block":
                state[source] = True
    assert got == want
    # A batch that is run again reads the state before it, and gives the same.
    again, after = block_step(spark.createDataFrame(parts[1], SCHEMA), spark.read.schema(BLOCK_STATE).parquet(str(tmp_path / "run" / "state" / "batch=0")))
    assert {(r.source, r.event_id): r.blocked for r in again.collect()} == {k: v for k, v in want.items() if k[1] in {x[1] for x in parts[1]}}


def test_pins_over_batches(spark, tmp_path):
    parts = batches(3)
    run_with_state(streamed(spark, tmp_path, parts), pin_step, PIN_STATE, "file://" + str(tmp_path / "run")).awaitTermination()
    got = {(r.source, r.event_id): r.state for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()}
    pins, want = {}, {}
    for rows in parts:
        for source, n, _, _, _, digest in sorted(rows, key=lambda x: (x[2], x[1])):
            if digest is not None:
                want[source, n] = "new" if source not in pins else "known" if pins[source] == digest else "changed"
                pins.setdefault(source, digest)
    assert got == want


def test_steps_on_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    for step, schema in ((block_step, BLOCK_STATE), (pin_step, PIN_STATE)):
        rows, after = step(none, spark.createDataFrame([("a", None)], schema))
        assert rows.count() == 0 and after.count() == 1


def test_late_events_are_left_out_of_closed_windows(spark, tmp_path):
    at = lambda h, m: START + timedelta(hours=h, minutes=m)
    parts = [[("a", 1, at(0, 5), 0, None, None), ("a", 2, at(5, 0), 0, None, None)], [("a", 3, at(6, 0), 0, None, None)], [("a", 4, at(0, 6), 0, None, None), ("a", 5, at(5, 55), 0, None, None)]]
    out = windowed_counts(streamed(spark, tmp_path, parts), late="1 hour")
    q = out.writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    starts = [r.start for r in spark.table("late").collect()]
    assert starts.count(at(0, 0)) == 1 and at(5, 50) in starts  # the late one at 0:06 has no second count; the one within the hour has
