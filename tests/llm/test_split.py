import random

import pytest
from pyspark.sql import functions as F

from siftspark.llm.split import context_pieces, split_items

TEXTS = [
    None,
    "",
    " ",
    "short",
    "One sentence here. Another one there. " * 40,
    "word " * 500,
    "x" * 3000,
    "é" * 0 + "é" * 700,
    "文本很长没有空格。" * 150,
    "文" * 900,
    "👩‍🔬🏳️‍🌈👍🏽🇨🇭" * 120,
    "🇨🇭" * 300,
    "para one\n\npara two is longer\n\n\n" * 60,
    "a,b;c/d-e_f=g&h" * 100,
    "line\r\n" * 300,
    "def f(x):\n    return x\n\n" * 50,
    "\n" * 700,
    "́" * 500,
    "word " * 100_000,
]


@pytest.mark.parametrize(("limit", "overlap"), [(158, 8), (254, 16), (10, 3), (2, 5), (1, 0), (0, None), (1022, 64), (50, 49)])
def test_pieces_fit_overlap_and_cover(spark, limit, overlap):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS) if limit >= 100 or t is None or len(t) < 5000]
    df = spark.createDataFrame([*rows, rows[4]], "id int, text string, piece string, n_pieces int").repartition(4)
    out = split_items(df, "text", F.lit(limit), F.lit(overlap).cast("int")).collect()
    most = max(limit, 1)
    shared = min(max(overlap or 0, 0), most - 1)
    by = {}
    for r in out:
        by.setdefault(r.id, {}).setdefault(r.piece_no, []).append(r)
    assert set(by) == {i for i, t, *_ in rows if t is not None}
    for i, pieces in by.items():
        text, at = TEXTS[i], 0
        assert sorted(pieces) == list(range(1, len(pieces) + 1))
        for no in sorted(pieces):
            assert len(pieces[no]) == (2 if i == rows[4][0] else 1)
            p = pieces[no][0]
            assert p.n_pieces == len(pieces)
            assert len(p.piece) <= most
            assert p.new_from == at and text[p.piece_from : p.piece_to] == p.piece
            assert p.piece_from == max(at - (shared if no > 1 else 0), 0)
            assert p.piece_to > p.new_from or text == ""
            at = p.piece_to
        assert at == len(text)
        assert (len(pieces) == 1) == (len(text) <= most)


def ends(spark, text, limit, overlap=0):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r.piece for r in sorted(split_items(df, "text", F.lit(limit), F.lit(overlap)).collect(), key=lambda r: r.piece_no)]


def test_strong_boundaries_come_first(spark):
    text = "First part. It has two sentences.\n\nSecond part follows here. More words and more."
    assert ends(spark, text, 60) == ["First part. It has two sentences.\n\n", "Second part follows here. More words and more."]
    assert ends(spark, "aaaa bbbb. cccc dddd eeee ffff", 16) == ["aaaa bbbb. ", "cccc dddd eeee ", "ffff"]
    assert ends(spark, "缓存比缓存更长。令牌保持不变。第五个", 10) == ["缓存比缓存更长。", "令牌保持不变。第五个"]
    assert ends(spark, "缓存比缓存更长；令牌保持不变。第五个", 9)[0] == "缓存比缓存更长；"


def test_combined_characters_stay_whole(spark):
    pieces = ends(spark, "👩‍🔬" * 40 + "é" * 40 + "🇨🇭" * 40 + "👍🏽" * 40, 10)
    for p in pieces:
        assert not p.startswith(("‍", "́", "\U0001f3fd", "🔬")) and not p.endswith("‍")
        assert p.count("🇨") == p.count("🇭")


def test_context_documents(spark):
    r = random.Random(1)
    models = spark.createDataFrame([("m", "1", 100, 10), ("m", "2", 60, 5), ("m", "none", None, None)], "model_id string, model_version string, max_tokens int, overlap_tokens int")
    rows = [(i, 0, "m", r.choice(["1", "2"]), "word " * r.randrange(40)) for i in range(50)] + [(99, 0, "m", "unknown", "word " * 99), (98, 0, "m", "none", "word " * 99), (97, 0, "m", "1", None)]
    rows += rows[:20]
    items = spark.createDataFrame(rows, "request_id long, doc_no int, model_id string, model_version string, text string")
    got = {r.request_id for r in context_pieces(items, models).where("piece_no = 2").collect()}
    assert got == {i for i, _, _, v, t in rows if t and v in "12" and len(t) + 2 > {"1": 100, "2": 60}[v]}
    assert context_pieces(items, models).where("piece_no = 2").count() == len(got)
    assert context_pieces(items.limit(0), models).count() == 0
    assert context_pieces(items, models.limit(0)).count() == 0
