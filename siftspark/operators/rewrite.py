"""Rewriting of texts by findings, event framing and phone masking, all as Spark expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators import redact

#: What stands for a stripped span.
STRIPPED = "[removed: {}]"


def merged_spans(spans: Column) -> Column:
    """Union of crossing spans (structs of start, end, label) of an array, in order; touching ones stay apart, the first label wins."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.label.alias("label"))))
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return F.aggregate(
        ordered,
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s.start < F.element_at(acc, -1).end),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1).start.alias("start"), F.greatest(F.element_at(acc, -1).end, -s.back).alias("end"), F.element_at(acc, -1).label.alias("label"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s.start.alias("start"), (-s.back).alias("end"), s.label.alias("label"))))),
    )


def stripped(docs: DataFrame, findings: DataFrame, key: str, text: str, least_level: int = 2) -> DataFrame:
    """key, stripped: the texts with the spans of findings of that level or more replaced; texts without any stay as they are.

    Spans are UTF-8 byte offsets; crossing ones are removed as one. Null texts stay null.
    """
    spans = (
        findings.where(F.col("level") >= least_level)
        .groupBy(key)
        .agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("category").alias("label"))).alias("__spans"))
        .select(key, merged_spans(F.col("__spans")).alias("__spans"))
    )
    joined = docs.select(key, text).join(spans, key, "left")
    raw = F.encode(text, "UTF-8")
    cut = lambda a, n: F.decode(F.substring(raw, a + 1, n), "UTF-8")
    # What is kept before each span, the span's replacement, and the rest after the last.
    parts = F.transform(
        "__spans",
        lambda s, i: F.concat(
            cut(F.when(i == 0, 0).otherwise(F.get("__spans", i - 1).end), s.start - F.when(i == 0, 0).otherwise(F.get("__spans", i - 1).end)),
            F.lit("[removed: "),
            s.label,
            F.lit("]"),
        ),
    )
    last = F.element_at("__spans", -1).end
    done = F.concat(F.array_join(parts, ""), cut(last, F.octet_length(text) - last))
    return joined.select(key, F.when(F.col("__spans").isNull() | (F.size("__spans") == 0), F.col(text)).otherwise(done).alias("stripped"))


def sse_events(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Server-sent events of each text: key, event_no, event, data. Data lines are joined by line feeds; a blank line ends an event.

    Comments and other fields are ignored; events without data aren't emitted; a last event without a blank line after it is.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    blocks = F.split(F.array_join(lines, "\n"), "\n\n+", -1)
    value = lambda line, name: F.regexp_replace(F.substring(line, len(name) + 2, 1 << 30), "^ ", "")
    exploded = texts.select(key, F.posexplode(blocks).alias("__i", "__block")).select(key, "__i", F.split("__block", "\n", -1).alias("__lines"))
    data = F.transform(F.filter("__lines", lambda x: F.startswith(x, F.lit("data:"))), lambda x: value(x, "data"))
    event = F.element_at(F.transform(F.filter("__lines", lambda x: F.startswith(x, F.lit("event:"))), lambda x: value(x, "event")), -1)
    kept = exploded.where(F.exists("__lines", lambda x: F.startswith(x, F.lit("data:"))))
    return kept.select(key, (F.col("__i") + 1).alias("event_no"), F.when(F.exists("__lines", lambda x: F.startswith(x, F.lit("event:"))), event).otherwise("message").alias("event"), F.array_join(data, "\n").alias("data"))


def mobiles(text: Column) -> Column:
    """All Russian mobile numbers of a text, as they stand; null and empty texts have none."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[t[m.start : m.end] for m in redact.mobiles(t)] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def mask_mobiles(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact.mask_matches(t, redact.mobiles(t)) if t else t for t in texts.to_pylist()], pa.string())

    return run(text)


def context_windows(texts: DataFrame, key: str, text: str, most: int = 512, overlap: int = 32) -> DataFrame:
    """Fixed windows over each text: key, window_no, start, end (characters), window. Texts within ``most`` are one window; empty ones give one, null ones none."""
    step = most - overlap
    n = F.char_length(text)
    last = F.when(n <= most, 0).otherwise(F.ceil((n - most) / step)).cast("int")
    rows = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text"), F.explode(F.sequence(F.lit(0), last)).alias("__no"))
    return rows.select(
        key,
        (F.col("__no") + 1).alias("window_no"),
        (F.col("__no") * step).alias("start"),
        F.least(F.col("__no") * step + most, F.char_length("__text")).alias("end"),
        F.substring("__text", F.col("__no") * step + 1, F.lit(most)).alias("window"),
    )
