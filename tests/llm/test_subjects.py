import random

import numpy as np
import pytest
from tallyspring.llm import subjects

TERMS = {
    "law": "plaintiff verdict clause statute witness tort injunction affidavit notary easement".split(),
    "music": "chord violin sonata tempo choir melody soprano arpeggio overture guitar".split(),
    "cooking": "recipe garlic oven whisk broth simmer custard risotto saffron ladle".split(),
}
FILLER = "the row was shown twice when it is empty please keep every value as reported by desk and then add note".split()


def document(r, kinds, lines=12):
    out = []
    for _ in range(lines):
        kind = r.choice(kinds)
        words = [r.choice(FILLER) for _ in range(6)]
        words[r.randrange(6)] = r.choice(TERMS[kind])
        out.append(r.choice(["+", "-", " "]) + " ".join(words))
    return "\n".join(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    docs, truth = [], {}
    for i in range(400):
        kinds = r.sample(sorted(TERMS), 2 if r.random() < 0.2 else 1)
        docs.append((i, document(r, kinds)))
        truth[i] = set(kinds)
    return docs, truth


def test_words():
    assert subjects.words("halfLife half_life HTTPClient galaxySurvey") == ["half", "life", "half", "life", "http", "client", "galaxy", "survey"]
    assert subjects.words("酵素を") == ["酵素", "素を"] and subjects.words("Слово, x") == ["слово", "x"]
    assert subjects.words("commit 1234567abc\nMerge branch 'release' into main\nAuthor: A <a@b>\nadd garlic") == ["add", "garlic"]
    assert subjects.words("diff --git a/static/guitar.zip b/static/guitar.zip\nBinary files a/guitar.png and b differ") == []


def test_bisecting_kmeans_parts_what_is_apart():
    rng = np.random.default_rng(0)
    centres = np.eye(6)[:4]
    x = np.repeat(centres, 25, axis=0) + rng.normal(0, 0.05, (100, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf = subjects.bisecting_kmeans(x, 4, 5)
    assert all(len(set(leaf[i * 25 : i * 25 + 25])) == 1 for i in range(4)) and len(set(leaf)) == 4


def test_held_out_accuracy_with_wrong_labels(spark, corpus):
    docs, truth = corpus
    r = random.Random(2)
    labels = []
    for i in range(200):
        for s in truth[i] if r.random() > 0.05 else {r.choice(sorted(TERMS))}:
            labels.append((i, s))
    rows = [(i, t) for i, t in docs] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Merge branch 'x' into y"), (1004, "wip"), (1005, docs[0][1]), (1006, docs[0][1] * 300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS subject", "1 AS labels", "2 AS k")
    lab = spark.createDataFrame([*labels, (5, None), (99999, "law"), (1000, "law")], "doc_id long, subject string")
    got = {}
    for x in subjects.assign_subjects(d, lab, sorted(TERMS)).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    right = sum(got.get(i) == truth[i] for i in range(200, 400))
    assert right >= 190
    assert not {1000, 1001, 1002, 1003, 1004} & set(got) and got[1005] == got[0] == got[1006]


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "plaintiff verdict")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.assign_subjects(d, lab, ["law"]).count() == 0
    assert subjects.assign_subjects(d.limit(0), spark.createDataFrame([(1, "law")], lab.schema), ["law"]).count() == 0


def test_leaves_of_the_corpus_are_named_by_their_terms(spark, corpus, monkeypatch):
    docs, truth = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, s) for i in range(60) for s in truth[i]], "doc_id long, subject string")
    model, known = subjects.learn(d, labels, sorted(TERMS), "doc_id", "text", "subject")
    assert known.count() == len(docs)
    own = {s: set(t) for s, t in TERMS.items()}
    for s, terms in zip(model.leaf_subjects, model.leaf_terms):
        if terms:
            assert len(own[s] & set(terms[:4])) >= 2, (s, terms)
    assert set(model.leaf_subjects) == set(TERMS)
    # however the corpus is dealt to tasks and brought together, each document counts once
    monkeypatch.setattr(subjects, "TOGETHER", 40)
    dims = np.arange(30)
    leaves = subjects.corpus_leaves(known, dims, np.ones(30))
    vectors = subjects.corpus_leaves(known.coalesce(1), dims, np.ones(30))
    assert leaves.mass.sum(axis=0) == pytest.approx(vectors.mass.sum(axis=0), rel=1e-4)
