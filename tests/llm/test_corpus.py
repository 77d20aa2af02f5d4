import base64
import random
from collections import Counter, defaultdict

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.llm.encode import Encoder, Vocabulary, default_pattern, default_vocabulary, encode_corpus, model_from_ranks
from siftspark.llm.mix import mixture, pivot, shares


@pytest.fixture(scope="module")
def encoder():
    return Encoder(model_from_ranks(default_vocabulary()), default_pattern())


@pytest.fixture(scope="module")
def public():
    with open(default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text(alphabet="ab cdeEé\n\t1'’日本0 x", max_size=300)))
def test_ids_equal_the_public_tokenizer_and_round_trip(encoder, public, text):
    ids = list(encoder.encode(text))
    assert ids == public.encode_ordinary(text)
    assert encoder.decode(ids) == text
    assert encoder.count(text) == len(ids)


def test_long_pretokens(encoder, public):
    for text in ("a" * 20_000, "the" * 5_000, " " * 9_999, "\n" * 5_000 + "x", "<|endoftext|>" * 3, "ß" * 4_000):
        assert list(encoder.encode(text)) == public.encode_ordinary(text)


def test_defined_ids_for_null_and_empty(spark):
    rows = [(1, None, "clash"), (2, "", "x"), (3, "hello world", None), (3, "hello world", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert [len(i) for _, i in got][:2] == [0, 0]
    assert got[2] == got[3]
    assert encode_corpus(df.limit(0)).count() == 0
    v = Vocabulary(spark)
    back = encode_corpus(df).select("text", v.text(F.col("ids")).alias("back"), v.count(F.col("text")).alias("n"), "ids").collect()
    assert all(r.back == (r.text or "") and r.n == len(r.ids) for r in back)


@settings(max_examples=500, deadline=None)
@given(st.integers(1, 10**6), st.floats(1e-6, 1 - 1e-6), st.integers(1, 10**6), st.floats(1e-6, 1 - 1e-6), st.floats(0, 0.999999))
def test_pivot_keeps_tokens_and_settles_one(s, a, t, b, draw):
    x, y = pivot(s, a, t, b, draw)
    assert s * x + t * y == pytest.approx(s * a + t * b)
    assert -1e-6 < x < 1 + 1e-6 and -1e-6 < y < 1 + 1e-6
    assert min(min(v, 1 - v) for v in (x, y)) < 1e-6


def test_pivot_keeps_expectations():
    r = random.Random(1)
    for s, a, t, b in ((10, 0.3, 25, 0.6), (7, 0.9, 7, 0.9), (100, 0.5, 3, 0.2)):
        drawn = [pivot(s, a, t, b, r.random()) for _ in range(20_000)]
        assert sum(x for x, _ in drawn) / 20_000 == pytest.approx(a, abs=0.02)
        assert sum(y for _, y in drawn) / 20_000 == pytest.approx(b, abs=0.02)


TARGETS = [("hot", 0.5, 2), ("mid", 0.3, 3), ("tiny", 0.2, 6), ("absent", 0.1, 4), (None, 0.1, 1), ("unwanted", None, 2), ("null cap", 0.0, None)]


def corpus(spark):
    r = random.Random(3)
    rows = [(i, "hot", r.randrange(1, 900)) for i in range(3000)] + [(10_000 + i, "mid", r.randrange(1, 900)) for i in range(700)]
    rows += [(20_000 + i, "tiny", 100 + i) for i in range(15)] + [(30_000, "unlisted", 50), (30_001, None, 50), (30_002, "hot", None), (30_003, "hot", 0), (30_004, "unwanted", 9)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long"), rows


@pytest.mark.parametrize("group", [10_000, 40])
def test_shares_are_reached_and_caps_hold(spark, group):
    df, rows = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixture(df.repartition(7), targets, group=group)
    got = mixed.collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, s, _ in rows if s in {"hot", "mid", "tiny", "unwanted"})
    caps = {s: m or 1 for s, _, m in TARGETS}
    largest = defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= caps[r.source]
        largest[r.source] = max(largest[r.source], r.tokens)
    whole = sum(r.tokens * r.copies for r in got)
    by = Counter()
    for r in got:
        by[r.source] += r.tokens * r.copies
    for source, share in (("hot", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(by[source] - share * whole) <= largest[source]
    assert by["unwanted"] == 0
    table = {r.source: r for r in shares(mixed, targets).collect()}
    assert table["absent"].actual_share == 0 and table["hot"].actual_share == pytest.approx(by["hot"] / whole)
    again = {r.doc_id: r.copies for r in mixture(df.repartition(3), targets, group=group).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_a_given_total_caps_and_reports(spark):
    df, _ = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixture(df, targets, total_tokens=10**7)
    assert {r.copies for r in mixed.where("source = 'tiny'").collect()} == {6}
    assert mixture(df.limit(0), targets).count() == 0
    assert mixture(df, targets.limit(0)).count() == 0
    assert shares(mixture(df.limit(0), targets), targets).count() == len(TARGETS)
