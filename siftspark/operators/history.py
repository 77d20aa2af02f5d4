"""History of changing entity attributes: a bitemporal ledger and the versions it yields.

The ledger keeps, for each entity, which update described which stretch of valid
time, and from when to when that was what the ledger knew (recorded time). A late
update splits the interval it falls into; the split interval isn't overwritten, its
row is closed at the recorded time of the late update and shorter rows follow.

Work on one entity is cut into spans of valid time, so that no entity, however hot,
is one task: each (entity, span) group is swept on its own, and what a span must know
of later spans is handed to it as a few marks (the earliest valid time known there,
each time it falls).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.functions.canonical import canonical_json
from siftspark.session import cut_lineage

#: Length of a span of valid time. Valid times are whole seconds, so a group has at most this many rows after updates of one valid time are merged.
SPAN_SECONDS = 30 * 86_400

_V, _R, _ID, _SPAN, _MARK = "__valid", "__recorded", "__id", "__span", "__mark"


def _marks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each span, the arrivals in later spans that change what comes next after it.

    An arrival matters to earlier spans only if it is the earliest valid time of its
    span so far, and only to the spans from the nearest earlier one that already had a
    row at that time up to its own.
    """
    by_span = Window.partitionBy(*keys, _SPAN).orderBy(_R, _ID).rowsBetween(Window.unboundedPreceding, -1)
    falls = (
        rows.select(*keys, _SPAN, _V, _R, _ID)
        .withColumn("__before", F.min(_V).over(by_span))
        .where(F.col("__before").isNull() | (F.col(_V) < F.col("__before")))
    )
    # One small array of (span, first arrival) for each entity: its length is the number of spans, not of rows.
    spans = (
        rows.groupBy(*keys, _SPAN)
        .agg(F.min(_R).alias("first"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(_SPAN).alias("span"), "first"))).alias("__spans"))
        .where(F.size("__spans") > 1)
    )
    joined = falls.join(spans, keys)
    earlier = F.filter("__spans", lambda s: s.span < F.col(_SPAN))
    nearest = F.array_max(F.transform(F.filter(earlier, lambda s: s["first"] <= F.col(_R)), lambda s: s.span))
    reach = F.filter(earlier, lambda s: nearest.isNull() | (s.span >= nearest))
    return joined.select(*keys, F.explode(F.transform(reach, lambda s: s.span)).alias(_SPAN), _V, _R, _ID, F.lit(True).alias(_MARK))


def bitemporal_ledger(
    updates: DataFrame,
    keys: list[str],
    values: list[str],
    valid: str,
    recorded: str,
    tie: str,
    span_seconds: int = SPAN_SECONDS,
) -> DataFrame:
    """Ledger of ``updates``: keys, values, valid_from, valid_to, recorded_from, recorded_to, current.

    Each update describes its entity from ``valid`` until the next update known. A row
    with ``current`` is what the ledger knows now; the others were superseded at
    ``recorded_to``. ``valid_to`` null means no later update was known. Of updates of one
    valid time the one recorded last counts (``tie`` decides equal recorded times).

    Null keys form an entity of their own; rows with null valid or recorded time can't be
    placed and are left out; an empty table gives an empty ledger; repeated rows give
    no row of their own beyond the superseded one; columns not named are ignored.
    """
    rows = (
        updates.where(F.col(valid).isNotNull() & F.col(recorded).isNotNull())
        .select(
            *[F.struct(*[F.col(k) for k in keys]).alias("__key")],
            F.struct(*[F.col(v) for v in values]).alias("__values"),
            F.unix_micros(F.col(valid).cast("timestamp")).alias(_V),
            F.unix_micros(F.col(recorded).cast("timestamp")).alias(_R),
            F.col(tie).cast("long").alias(_ID),
        )
        .withColumn(_SPAN, F.floor(F.col(_V) / (span_seconds * 1_000_000)).cast("long"))
    )
    # Keys are joined and grouped by a string that tells nulls from any text.
    rows = rows.withColumn("__k", F.to_json(F.col("__key"), {"ignoreNullFields": "false"}))
    value_type = rows.schema["__values"].dataType
    key_type = rows.schema["__key"].dataType
    marks = _marks(rows, ["__k"])
    every = rows.withColumn(_MARK, F.lit(False)).unionByName(marks, allowMissingColumns=True)
    swept_type = T.StructType(
        [
            T.StructField("__key", key_type),
            T.StructField("__values", value_type),
            *[T.StructField(c, T.LongType()) for c in ("valid_from", "valid_to", "recorded_from", "recorded_to")],
        ]
    )
    swept = (
        every.repartition("__k", _SPAN)
        .sortWithinPartitions("__k", _SPAN, _R, _ID)
        .select("__k", "__key", "__values", _V, _R, _ID, _SPAN, _MARK)
        .mapInArrow(_sweep, swept_type)
    )
    when = lambda c: F.timestamp_micros(F.col(c)).cast(updates.schema[valid].dataType).alias(c)
    return swept.select(
        *[F.col("__key")[k].alias(k) for k in keys],
        *[F.col("__values")[v].alias(v) for v in values],
        *map(when, ("valid_from", "valid_to", "recorded_from", "recorded_to")),
        F.col("recorded_to").isNull().alias("current"),
    )


class _Span:
    """Sweep line over one (entity, span) group in recorded order."""

    __slots__ = ("horizon", "known", "order", "out")

    def __init__(self, out: list) -> None:
        self.order: list[int] = []  # valid times known, ascending
        self.known: dict[int, list] = {}  # valid time -> [key, values, valid_to, recorded_from]
        self.horizon: int | None = None  # earliest valid time known in later spans
        self.out = out

    def close(self, at: int, now: int) -> list:
        row = self.known[at]
        if row[3] < now:  # what was recorded and superseded at one instant was never known
            self.out.append((row[0], row[1], at, row[2], row[3], now))
        return row

    def update(self, key, values, at: int, now: int) -> None:
        if at in self.known:
            row = self.close(at, now)
            self.known[at] = [key, values, row[2], now]
            return
        place = bisect_left(self.order, at)
        until = self.order[place] if place < len(self.order) else self.horizon
        if place:
            before = self.order[place - 1]
            row = self.close(before, now)
            self.known[before] = [row[0], row[1], at, now]
        insort(self.order, at)
        self.known[at] = [key, values, until, now]

    def mark(self, at: int, now: int) -> None:
        if self.horizon is not None and self.horizon <= at:
            return
        self.horizon = at
        if self.order:
            last = self.order[-1]
            row = self.close(last, now)
            self.known[last] = [row[0], row[1], at, now]

    def end(self) -> None:
        for at in self.order:
            key, values, until, since = self.known[at]
            self.out.append((key, values, at, until, since, None))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list = []
    span, name = None, None
    types = None

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        made = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], types[0]), pa.array(columns[1], types[1]), *[pa.array(c, pa.int64()) for c in columns[2:]]],
            names=["__key", "__values", "valid_from", "valid_to", "recorded_from", "recorded_to"],
        )
        out.clear()
        return made

    for b in batches:
        types = (b.schema.field("__key").type, b.schema.field("__values").type)
        for k, key, values, v, r, s, is_mark in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6, 7)], strict=True):
            if (k, s) != name:
                if span:
                    span.end()
                span, name = _Span(out), (k, s)
            if is_mark:
                span.mark(v, r)
            else:
                span.update(key, values, v, r)
        if len(out) > 5_000:
            yield batch()
    if span:
        span.end()
        yield batch()


def versions(
    ledger: DataFrame,
    keys: list[str],
    values: list[str],
    listed: str | None = None,
    json_values: tuple[str, ...] = (),
    span_seconds: int = SPAN_SECONDS,
) -> DataFrame:
    """Versions of each entity's ``values`` in the ledger's current rows: keys, values, valid_from, valid_to.

    A null value repeats the entity's previous one. Rows where ``listed`` isn't true end a
    version and describe nothing. ``json_values`` are compared as JSON values, the others by
    character. ``valid_to`` is null for a version that hasn't ended.

    Running values are taken within spans of valid time and carried from span to span by one
    small row a span, so a hot entity is spread over tasks.
    """
    on = F.col(listed).eqNullSafe(True) if listed else F.lit(True)
    rows = ledger.where("current").select(
        F.struct(*keys).alias("__key"),
        F.col("valid_from").alias("__v"),
        on.alias("__on"),
        *[F.when(on, F.col(v)).alias(v) for v in values],
        F.floor(F.unix_seconds(F.col("valid_from").cast("timestamp")) / span_seconds).alias(_SPAN),
    )
    for v in json_values:
        rows = rows.withColumn(f"__c_{v}", canonical_json(F.col(v)))
    rows = cut_lineage(rows)  # read several times below; the sweep shall run once
    same = {v: f"__c_{v}" if v in json_values else v for v in values}
    tracked = sorted({*values, *same.values()})

    within = Window.partitionBy("__key", _SPAN).orderBy("__v")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    over_spans = Window.partitionBy("__key").orderBy(_SPAN)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__v")))

    carried = (
        rows.groupBy("__key", _SPAN)
        .agg(*[last(c).alias(c) for c in tracked], F.max_by("__on", "__v").alias("__on"))
        .select(
            "__key",
            _SPAN,
            *[F.last(c, ignorenulls=True).over(over_spans.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__in_{c}") for c in tracked],
            F.lag("__on").over(over_spans).alias("__in_on"),
        )
    )
    joined = _with_spans(rows, carried)
    filled = joined
    for c in tracked:
        filled = filled.withColumn(f"__f_{c}", F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"__in_{c}")))
        filled = filled.withColumn(f"__p_{c}", F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(f"__in_{c}")))
    filled = filled.withColumn("__was_on", F.coalesce(F.lag("__on").over(within), F.col("__in_on"), F.lit(False)))
    differs: Column = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"__f_{same[v]}").eqNullSafe(F.col(f"__p_{same[v]}"))
    events = filled.withColumn("__starts", F.col("__on") & (~F.col("__was_on") | differs)).where(
        F.col("__starts") | (~F.col("__on") & F.col("__was_on"))
    )
    firsts = (
        events.groupBy("__key", _SPAN)
        .agg(F.min("__v").alias("__first"))
        .select("__key", _SPAN, F.min("__first").over(over_spans.rowsBetween(1, Window.unboundedFollowing)).alias("__next_span"))
    )
    ended = _with_spans(events, firsts).withColumn("valid_to", F.coalesce(F.lead("__v").over(within), F.col("__next_span")))
    return ended.where("__starts").select(
        *[F.col("__key")[k].alias(k) for k in keys],
        *[F.col(f"__f_{v}").alias(v) for v in values],
        F.col("__v").alias("valid_from"),
        "valid_to",
    )


def _with_spans(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``rows`` with the columns of the one ``summary`` row of its span."""
    s = summary.withColumnsRenamed({"__key": "__skey", _SPAN: "__sspan"})
    return rows.join(s, rows["__key"].eqNullSafe(s["__skey"]) & (rows[_SPAN] == s["__sspan"]), "left").drop("__skey", "__sspan")


def tool_versions(snapshots: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Versions of each tool's description and input_schema: server, name, description, input_schema, valid_from, valid_to."""
    ledger = tool_ledger(snapshots, span_seconds)
    return versions(ledger, ["server", "name"], ["description", "input_schema"], "listed", ("input_schema",), span_seconds)


def tool_ledger(snapshots: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Bitemporal ledger of tool snapshots."""
    return bitemporal_ledger(
        snapshots, ["server", "name"], ["description", "input_schema", "listed"], "seen_at", "received_at", "snapshot_id", span_seconds
    )
