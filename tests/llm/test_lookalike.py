import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm.lookalike import LOOKALIKES, _normal, _tables, lookalike_class_sizes, lookalike_classes, lookalike_pairs, one_form, one_form_column

SAME = [
    ("Ｈｅｌｌｏ，", "Hello,"),
    ("café", "café"),
    ("pаypаl", "paypal"),
    ("a​b­c﻿⁠᠎", "abc"),
    ("a b c d　e", "a b c d e"),
    ("co‐op‑s－x", "co-op-s-x"),
    ("сём", "cëм"),
    ("ｶﾞ", "ガ"),
    ("각", "각"),
    ("3‍4", "34"),
    ("q̣̇", "q̣̇"),
    ("​", ""),
    ("Ӏӏ", "Il"),
    ("ոսօ", "nuo"),
    ("Å", "Å"),
]
DIFFERENT = [
    ("Case", "case"),
    ("é", "e"),
    ("m²", "m2"),
    ("½", "1/2"),
    ("™", "TM"),
    ("ﬁ", "fi"),
    ("a–b", "a-b"),
    ("a—b", "a-b"),
    ("a b", "ab"),
    ("a  b", "a b"),
    ("ª", "a"),
    ("👩‍🔬", "👩🔬"),
    ("ß", "ss"),
    ("ё", "е"),
    ("й", "и"),
    ("I", "l"),
    ("①", "1"),
    ("a\nb", "a b"),
    ("π", "n"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert one_form(a) == one_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert one_form(a) != one_form(b)


ODD = "".join(LOOKALIKES) + "aеȩ́̈é‍​️Ａｱﾞﾞ각  👩🔬🏳ё-‑\n"


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=ODD, max_size=40)))
def test_segments_spliced_equal_the_whole_normalised(text):
    form = one_form(text)
    assert one_form(form) == form
    assert unicodedata.is_normalized("NFC", form)
    for c in "‍︎️":
        text = text.replace(c, "")
        form = form.replace(c, "")
    if not any(c in "‍︎️" for c in text):
        assert one_form(text) == _normal(text)


def test_stable_texts_are_not_touched():
    assert _tables()[1].search("Größe, naïveté – “so” 日本語 ™ ²") is None
    assert one_form(None) is None


def test_pairs_match_brute_force(spark):
    r = random.Random(5)
    base = ["paypal", "café au lait", "", "Case", "case", "m2", "m²", "co-op", "x" * 9000]
    swap = {"a": "а", "e": "е", "-": "‑", "o": "ο", "é": "é"}
    rows = []
    for i in range(150):
        value = lambda: None if r.random() < 0.15 else "".join(swap.get(c, c) if r.random() < 0.3 else c for c in r.choice(base)) + r.choice(["", "", "​"])
        rows.append((i, value(), value(), "clash", "y"))
    rows += [(200 + i, "hot one", None, "c", "d") for i in range(300)] + [(600, "hot one", None, None, None)]
    df = spark.createDataFrame(rows, "scan_id long, raw string, text string, fld string, class string").repartition(4)
    want = set()
    for k, fld in ((1, "raw"), (2, "text")):
        for a, b in itertools.combinations(rows, 2):
            if a[k] is not None and b[k] is not None and a[k] != b[k] and one_form(a[k]) == one_form(b[k]):
                want.add((fld, a[0], b[0]))
    got = [(p.fld, p.a, p.b) for p in lookalike_pairs(df, "scan_id", ["raw", "text"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert lookalike_classes(df, "scan_id", ["raw", "text"]).count() == sum((x[1] is not None) + (x[2] is not None) for x in rows)
    salted = [(p.fld, p.a, p.b) for p in lookalike_pairs(df.union(df.limit(40)), "scan_id", ["raw", "text"], cell=7).collect()]
    assert len(salted) == len(want) and set(salted) == want
    assert lookalike_pairs(df.limit(0), "scan_id", ["raw"]).count() == 0
    sizes = {(x.fld, x["class"]): (x.variants, x.members) for x in lookalike_class_sizes(df, "scan_id", ["raw", "text"]).collect()}
    by_class = {}
    for x in lookalike_classes(df, "scan_id", ["raw", "text"]).collect():
        by_class.setdefault((x.fld, x["class"]), []).append(x.value_hash)
    assert sizes == {k: (len(set(v)), len(v)) for k, v in by_class.items()}
    forms = df.select("raw", one_form_column(df.raw).alias("form")).collect()
    assert all(x.form == one_form(x.raw) for x in forms)
