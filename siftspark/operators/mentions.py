"""Which names of a list a text holds, without a pair of rows ever being formed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that are looked for in one pass.
AT_ONCE = 100_000


def mentions(rows: DataFrame, names: DataFrame, text: str, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """The columns of ``rows`` but ``text``, and ``name``: one row for each row and each of the ``names`` (their first column) that its array of texts holds.

    An automaton of the names reads each text once. A list of more than ``at_once`` names is taken in parts chosen by hash, one pass over the rows for each, so
    what is sent to the workers is bounded and no name is left out. Null and empty names and null texts match nothing.
    """
    spark = rows.sparkSession
    column = names.columns[0]
    distinct = names.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    rest = [c for c in rows.columns if c != text]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), f"`{name}` string"])
    parts = -(-distinct.count() // at_once)
    out = spark.createDataFrame([], schema)
    for part in range(parts):
        some = [r[0] for r in distinct.where(F.pmod(F.xxhash64(column), F.lit(parts)) == part).collect()]
        if not some:
            continue
        sent = spark.sparkContext.broadcast(some)  # about ``at_once`` names

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n in sent.value:
                automaton.add_word(n, n)
            automaton.make_automaton()
            for batch in batches:
                at: list[int] = []
                found: list[str] = []
                for i, texts in enumerate(batch.column(len(rest)).to_pylist()):
                    hits = {n for t in texts or () if t for _, n in automaton.iter(t)}
                    at += [i] * len(hits)
                    found += sorted(hits)
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(taken) for j in range(len(rest))), pa.array(found, pa.string())], names=[*rest, name])

        out = out.unionByName(rows.select(*rest, text).mapInArrow(look, schema))
    return out
