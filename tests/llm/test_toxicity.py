"""The field against enumeration of all state sequences; held-out accuracy; odd rows."""

import itertools
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as T


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    lengths = np.array([3, 1, 6, 2])
    scores, start, step = rng.normal(0, 2, 12), rng.normal(size=2), rng.normal(size=(2, 2))
    got, first, steps = T.Chains(lengths).marginals(scores, start, step)
    want, first_want, steps_want, at = [], np.zeros(2), np.zeros((2, 2)), 0
    for n in lengths:
        e, total, p = scores[at:at + n], 0.0, np.zeros(n)
        f, m = np.zeros(2), np.zeros((2, 2))
        for z in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(start[z[0]] + sum(step[a, b] for a, b in zip(z, z[1:], strict=False)) + sum(x for x, y in zip(e, z, strict=True) if y))
            total += w
            p += w * np.array(z)
            f[z[0]] += w
            for a, b in zip(z, z[1:], strict=False):
                m[a, b] += w
        want += list(p / total)
        first_want += f / total
        steps_want += m / total
        at += n
    assert np.allclose(got, want) and np.allclose(first, first_want) and np.allclose(steps, steps_want)


def test_sentences_cut():
    items = T._ITEM.findall("One two. Three\nfour" + " x" * 600)
    end = np.array([not x[0].isalpha() for x in items])
    assert T.sentences(end, np.zeros(len(items), int)).tolist() == [2, 1, 512, 89]
    assert T.sentences(np.zeros(0, bool), np.zeros(0, int)).tolist() == []


@pytest.mark.parametrize(("sf", "auc", "recall"), [("sf0.01", 0.8, 0.5), ("sf0.1", 0.9, 0.75)])
def test_held_out_accuracy(sf, auc, recall):
    rows = duckdb.connect().sql(f"""SELECT d.doc_id, d.text, l.toxic FROM '/root/testdata/{sf}/documents.parquet' d
        JOIN '/root/testdata/{sf}/labels.parquet' l USING (doc_id)""").fetchall()
    out = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    known = [r for r, o in zip(rows, out, strict=True) if not o]
    model = T.train([r[1] for r in known], [r[2] for r in known], sum(r[2] for r in known) / len(known))
    test = [r for r, o in zip(rows, out, strict=True) if o]
    score = model.document_scores(*T.Scorer(model).marginals([r[1] for r in test]))
    truth = np.array([r[2] for r in test], bool)
    better = (score[truth][:, None] > score[~truth][None, :]) + 0.5 * (score[truth][:, None] == score[~truth][None, :])
    assert better.mean() > auc
    predicted = score >= 0.7
    assert predicted[truth].mean() > recall and predicted[~truth].mean() < 0.02


def test_copies_count_about_once():
    """A name in many near copies of one toxic document doesn't mark toxic tokens; an insult in varied ones does."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, labels = [], []
    base = [word() for _ in range(60)]
    for _ in range(200):  # near copies with their own changed word
        words = [*base]
        words[rng.integers(60)] = word()
        texts.append(" ".join([*words, "zorro"]))
        labels.append(1)
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[rng.integers(60)] = "quaxer"
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = T.train(texts, labels, 0.3)
    assert model.word_score("quaxer") > 5 > model.word_score("zorro")


def test_fixed_wording_marks():
    """An insult that always follows the same words marks toxic tokens if the documents are otherwise different."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        words[10:10] = "you are a worthless zorrik".split() if i % 4 == 0 else "you are a friend".split()
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = T.train(texts, labels, 0.25)
    assert min(model.word_score("zorrik"), model.word_score("worthless")) > 5 > model.word_score("you")
    score = model.document_scores(*T.Scorer(model).marginals(["so you are a worthless zorrik today", "so you are a friend today"]))
    assert score[0] > 0.7 > 0.5 > score[1]


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    bad = [(i, " ".join([word(), word(), *["quaxer"] * (i % 3 == 0), word(), word()]), "en", 3.5) for i in range(300)]
    odd = [(None, None, None, None), (None, "Quaxer. quaxer\nfine", "x", 1.0), (5000, "", "x", 1.0), (5001, "12 ... !!", "x", 1.0),
           (5002, "fine " * 200_000 + "quaxer", "x", 1.0), (5003, "twice quaxer", "x", 1.0), (5003, "twice quaxer", "x", 1.0)]
    docs = spark.createDataFrame(bad + odd, "doc_id long, text string, spans string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(300)] + [(None, 1, 0), (1, None, 0), (9999, 1, 0)], "doc_id long, toxic int, text int")
    model = T.fit(docs, labels, ~T.held_out(F.col("doc_id")))
    got = T.score(docs, model).collect()
    assert len(got) == 307 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5000][0].score == by[5001][0].score == min(r.score for r in got) < 0.5
    assert [s.asDict()["start"] for s in by[5002][0].spans] == [1_000_000] and by[5002][0].n_tokens == 200_001
    assert len(by[5003]) == 2 and by[5003][0].score == by[5003][1].score > 0.7
    null = {r.n_tokens: r for r in by[None]}
    assert null[0].spans == [] and [(s.start, s.end) for s in null[3].spans] == [(0, 14)]
    assert T.score(docs.limit(0), model).collect() == []
    empty = T.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score < 0.5 for r in T.score(docs, empty).collect()} == {True}
