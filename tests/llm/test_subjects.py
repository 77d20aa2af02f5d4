import random

import numpy as np

from siftspark.llm.subjects import _weights, corpus_composition, document_subjects, subject_mixtures, terms

WORDS = {
    "law": "court judge verdict appeal statute jury lawyer contract".split(),
    "food": "oven flour recipe butter sauce knead simmer dough".split(),
    "sport": "goal referee league match striker coach stadium relay".split(),
}
FILLER = "the and page see again of with this about more".split()


def corpus(seed=1):
    r = random.Random(seed)
    rows, truth, labels = [], {}, []
    for i in range(300):
        own = r.sample(sorted(WORDS), r.choice([1, 1, 1, 2]))
        words = []
        for _ in range(40):
            s = r.choice(own)
            words += [r.choice(WORDS[s]), *r.choices(FILLER, k=2)]
        if r.random() < 0.3:
            words.append(r.choice(WORDS[r.choice(sorted(WORDS))]))  # a passing mention
        r.shuffle(words)
        rows.append((i, " ".join(words), "clash"))
        truth[i] = set(own)
        if i % 3 == 0:
            labels += [(i, s, "lab") for s in (own if r.random() > 0.05 else [r.choice(sorted(WORDS))])]
    labels += labels[:20] + [(5, "not a subject", "lab"), (None, "law", "lab"), (99_999, "law", "lab"), (6, None, "lab")]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (1003, " ".join(FILLER * 20), "x"), (1004, "court " * 50_000, "x"), (1005, "12 34 ### ==", "x")]
    truth[1004] = {"law"}
    return rows, truth, labels


def frames(spark):
    rows, truth, labels = corpus()
    return (
        spark.createDataFrame(rows, "doc_id long, text string, subject string").repartition(5),
        spark.createDataFrame(labels, "doc_id long, subject string, labeller string"),
        spark.createDataFrame([(s, "d") for s in WORDS], "subject string, description string"),
        truth,
    )


def test_subjects_of_a_small_corpus(spark):
    documents, labels, subjects, truth = frames(spark)
    got = {}
    for r in document_subjects(documents, labels, subjects).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [i for i in truth if i % 3]
    assert sum(got.get(i, set()) == truth[i] for i in held_out) / len(held_out) >= 0.97
    assert got[1004] == {"law"}
    assert not {1000, 1001, 1002, 1003, 1005} & set(got)


def test_without_labels_or_subjects_or_documents(spark):
    documents, labels, subjects, _ = frames(spark)
    assert subject_mixtures(documents, labels.limit(0), subjects).count() == 0
    assert subject_mixtures(documents, labels, subjects.limit(0)).count() == 0
    assert subject_mixtures(documents.limit(0), labels, subjects).count() == 0


def test_composition_adds_up(spark):
    documents, labels, subjects, _ = frames(spark)
    rows = corpus_composition(subject_mixtures(documents, labels, subjects)).collect()
    assert {r.subject for r in rows} == set(WORDS)
    assert abs(sum(r.share for r in rows) - 1) < 1e-9


def test_updates_never_worsen_the_fit():
    r = np.random.default_rng(3)
    profiles = r.random((50, 4)).astype(np.float32)
    profiles /= profiles.sum(0)
    row = np.repeat(np.arange(6), 8)
    columns = np.concatenate([r.choice(50, 8, replace=False) for _ in range(6)])
    counts = r.integers(1, 9, 48).astype(np.float32)

    def fit(n):
        w, entry = _weights(profiles, 6, row, columns, counts, n)
        return (counts * np.log((entry * w[row]).sum(1))).sum()

    fits = [fit(n) for n in range(1, 30)]
    assert all(b >= a - 1e-3 for a, b in zip(fits, fits[1:], strict=False))


def test_terms():
    assert terms(None) == {} and terms("") == {} and terms("1 2 # a1b2") == {}
    assert terms("Größe größe") == terms("gr\\u00f6\\u00dfe GRÖßE") and sum(terms("one two two").values()) == 3
    prose = "word " * 30
    assert terms(prose + "\n```sh\nmake it\n```\n") != terms(prose)  # code counts as what the text says
    assert sum(terms("x" * 3 + " " + "wort" * 50).values()) == 2  # words of any length
    assert len(terms("法院判决书")) == 4  # pairs of neighbours


def test_composition_keeps_thin_shares(spark):
    documents, labels, subjects, _ = frames(spark)
    cut, whole = (corpus_composition(subject_mixtures(documents, labels, subjects, least=x)).agg({"words": "sum"}).first()[0] for x in (0.01, 0.0))
    assert whole >= cut


def test_too_many_subjects_are_an_error(spark):
    import pytest

    documents, labels, _, _ = frames(spark)
    with pytest.raises(ValueError, match="subjects"):
        subject_mixtures(documents, labels, spark.range(100).selectExpr("cast(id as string) AS subject"))
