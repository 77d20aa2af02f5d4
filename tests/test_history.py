import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftspark.functions.canonical import canonical_json_text
from siftspark.operators.history import bitemporal_ledger, tool_ledger, tool_versions

SCHEMA = "snapshot_id long, server string, name string, description string, input_schema string, annotations string, listed boolean, seen_at timestamp_ntz, received_at timestamp_ntz, valid_to string, current int"
START = dt.datetime(2026, 1, 1)


def brute_versions(rows):
    latest = {}
    for r in rows:
        if r["seen_at"] is None or r["received_at"] is None:
            continue
        k = (r["server"], r["name"], r["seen_at"])
        if k not in latest or (r["received_at"], r["snapshot_id"]) > (latest[k]["received_at"], latest[k]["snapshot_id"]):
            latest[k] = r
    tools = defaultdict(list)
    for (s, n, _), r in latest.items():
        tools[s, n].append(r)
    out = set()
    for (s, n), own in tools.items():
        description = schema = None
        open_since = None
        for r in sorted(own, key=lambda r: r["seen_at"]):
            if not r["listed"]:
                if open_since:
                    out.add((s, n, open_since, r["seen_at"]))
                open_since = None
                continue
            d = description if r["description"] is None else r["description"]
            c = schema if r["input_schema"] is None else canonical_json_text(r["input_schema"])
            if open_since is None or (d, c) != (description, schema):
                if open_since:
                    out.add((s, n, open_since, r["seen_at"]))
                open_since = r["seen_at"]
            description, schema = d, c
        if open_since:
            out.add((s, n, open_since, None))
    return out


def brute_ledger(rows):
    """What was known at each arrival, arrival by arrival."""
    tools, out = defaultdict(list), []
    for r in rows:
        if r["seen_at"] and r["received_at"]:
            tools[r["server"], r["name"]].append(r)
    for (s, n), own in tools.items():
        before, known = {}, {}
        for now in sorted({r["received_at"] for r in own}):
            for r in sorted((r for r in own if r["received_at"] == now), key=lambda r: r["snapshot_id"]):
                known[r["seen_at"]] = r
            order = sorted(known)
            state = {(known[v]["snapshot_id"], v, order[i + 1] if i + 1 < len(order) else None) for i, v in enumerate(order)}
            for gone in set(before) - state:
                out.append((s, n, gone[1], gone[2], before.pop(gone), now))
            for new in state - set(before):
                before[new] = now
        out += [(s, n, k[1], k[2], since, None) for k, since in before.items()]
    return sorted(out, key=str)


def random_rows(seed, count=120):
    r = random.Random(seed)
    rows = []
    for i in range(count):
        seen = START + dt.timedelta(seconds=r.choice([r.randrange(40), r.randrange(4000)]))
        late = r.choice([1, 2, 5, 5000])
        schema = r.choice([None, '{"a": 1, "b": [1, 2]}', '{"b":[1,2],"a":1.0}', '{"a":1,"b":[2,1]}', '{"a": "\\u00f6"}', '{"a": "ö"}', "{broken"])
        rows.append((i, r.choice(["s", None, "hot", "hot", "hot"]), r.choice(["n", "n", None]), r.choice([None, "x", "y", "", "y" * 5000]), schema, None, r.choice([True, True, True, True, False, None]), seen, seen + dt.timedelta(seconds=r.randrange(late)), "clash", 1))
    rows += [(1000 + i, *row[1:]) for i, row in enumerate(rows[:10])]  # sent again, unchanged
    rows.append((5000, "s", "n", "x", None, None, True, None, START, "", 0))
    return rows


@pytest.mark.parametrize(("seed", "span"), [(1, 60), (2, 600), (3, 10), (4, 10**7)])
def test_versions_and_ledger_match_brute_force(spark, seed, span):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    dicts = [r.asDict() for r in df.collect()]
    got = {(r.server, r.name, r.valid_from, r.valid_to) for r in tool_versions(df, span).collect()}
    assert got == brute_versions(dicts)
    ledger = sorted(((r.server, r.name, r.valid_from, r.valid_to, r.recorded_from, r.recorded_to) for r in tool_ledger(df, span).collect()), key=str)
    assert ledger == brute_ledger(dicts)


def test_ledger_never_loses_a_superseded_row(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [(1, "k", "a", day(0), day(0)), (2, "k", "c", day(100), day(100)), (3, "k", "b", day(50), day(200))]
    df = spark.createDataFrame(rows, "id long, k string, v string, seen timestamp_ntz, got timestamp_ntz")
    ledger = bitemporal_ledger(df, ["k"], ["v"], "seen", "got", "id")
    as_of = lambda t: {(r.v, r.valid_from, r.valid_to) for r in ledger.where((F.col("recorded_from") <= F.lit(t)) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > F.lit(t)))).collect()}
    assert as_of(day(150)) == {("a", day(0), day(100)), ("c", day(100), None)}
    assert as_of(day(250)) == {("a", day(0), day(50)), ("b", day(50), day(100)), ("c", day(100), None)}
    assert ledger.count() == 5


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tool_versions(df).count() == 0
    assert tool_ledger(df).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"a":1,"b":2}', '{ "b": 2, "a": 1 }', True),
        ("[1,2]", "[2,1]", False),
        ('{"a":1.0}', '{"a":1}', True),
        ('{"a":100}', '{"a":1e2}', True),
        ('{"a":9007199254740993}', '{"a":9007199254740992}', False),
        ('{"a":true}', '{"a":1}', False),
        ('{"a":"1"}', '{"a":1}', False),
        ('"\\u00f6"', '"ö"', True),
        ("{x", "{y", False),
        ("null", '"null"', False),
        ("-0", "0", True),
    ],
)
def test_canonical_json(a, b, same):
    assert (canonical_json_text(a) == canonical_json_text(b)) is same


def test_canonical_json_deep_and_null():
    deep = "[" * 100_000 + "]" * 100_000
    assert canonical_json_text(deep) == "!" + deep
    assert canonical_json_text(None) is None
    assert json.loads(canonical_json_text('{"b":[{"z":null}]}')) == {"b": [{"z": None}]}
