from pyspark.sql import functions as F

from siftspark.operators.rewrite import context_windows, mask_mobiles, sse_events, stripped


def test_strip_merges_crossing_spans_by_bytes(spark):
    docs = spark.createDataFrame([(1, "é bad worse end"), (2, "clean"), (3, None), (4, "abcdef")], "doc_id int, text string")
    rows = [(1, 3, 3, 6, "x"), (1, 2, 5, 12, "y"), (1, 1, 0, 2, "base only"), (4, 2, 0, 3, "a"), (4, 2, 3, 6, "b"), (4, 2, 3, 6, "b")]
    found = spark.createDataFrame(rows, "doc_id int, level int, start int, end int, category string")
    got = {r.doc_id: r.stripped for r in stripped(docs, found, "doc_id", "text").collect()}
    assert got == {1: "é [removed: x] end", 2: "clean", 3: None, 4: "[removed: a][removed: b]"}


def test_sse_events(spark):
    text = ": comment\nevent: ping\ndata: a\ndata:b\n\ndata: c\r\n\r\n\nid: 3\n\ndata: last"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string")
    got = [(r.event, r.data) for r in sorted(sse_events(df, "k", "t").collect(), key=lambda r: r.event_no)]
    assert got == [("ping", "a\nb"), ("message", "c"), ("message", "last")]


def test_mobiles(spark):
    rows = [("+7 (912) 345-67-89 x", "[REDACTED:phone] x"), ("8-912-345-67-89", "[REDACTED:phone]"), ("call 79123456789.", "call [REDACTED:phone]."), ("+8 912 345 67 89", "+8 912 345 67 89"), ("id 1789123456789", "id 1789123456789"), ("8 495 123 45 67", "8 495 123 45 67"), ("2024-8-9123456789", "2024-8-9123456789"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    bad = [r for r in df.select("t", "want", mask_mobiles(F.col("t")).alias("got")).collect() if r.got != r.want]
    assert bad == []


def test_windows_cover_and_overlap(spark):
    df = spark.createDataFrame([(1, "x" * 1500), (2, "é" * 512), (3, ""), (4, None), (5, "y" * 513)], "k int, t string")
    by = {}
    for r in sorted(context_windows(df, "k", "t").collect(), key=lambda r: r.window_no):
        by.setdefault(r.k, []).append((r.start, r.end, len(r.window)))
    assert by == {1: [(0, 512, 512), (480, 992, 512), (960, 1472, 512), (1440, 1500, 60)], 2: [(0, 512, 512)], 3: [(0, 0, 0)], 5: [(0, 512, 512), (480, 513, 33)]}
