import random

import numpy as np
import pytest

from tessera.operators import latent, retrieve
from tessera.operators.embed import with_hashed_vector

GROUPS = [("car automobile engine wheel road driver".split()), ("apple pear orchard fruit tree juice".split()), ("violin concert orchestra music piano singer".split())]


def corpus(n=240, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = GROUPS[i % 3]
        # the two names of a thing never stand together
        words = [w for w in words if w != ("car" if i % 2 else "automobile")]
        rows.append((i, " ".join(r.choices(words, k=8) + r.choices(["the", "and", "of"], k=4))))
    return rows


def dense(rows, width):
    """The leading right singular vectors of the same matrix, by a full decomposition."""
    import pyarrow as pa

    x = np.zeros((len(rows), latent.FEATURES))
    lists = pa.array([r for _, r in rows], pa.list_(pa.int32()))
    _, f, _ = latent._sparse(lists, None)
    idf = np.zeros(latent.FEATURES)
    df = np.bincount(f, minlength=latent.FEATURES)
    idf[df > 0] = np.log((1 + len(rows)) / df[df > 0])
    row, feature, value = latent._sparse(lists, idf)
    x[row, feature] = value
    used = np.flatnonzero(df)
    _, s, v = np.linalg.svd(x[:, used], full_matrices=False)
    out = np.zeros((latent.FEATURES, width))
    out[used] = v[:width].T
    return out, s


def test_axes_span_the_leading_singular_vectors(spark):
    df = spark.createDataFrame(corpus(), "id long, text string").repartition(3)
    model = latent.fit(df, "id", "text", width=3)
    _, basis = model.load(spark)
    feats = [(r.id, r["_f"]) for r in latent._features(df, ["id"], "text").orderBy("id").collect()]
    want, s = dense(feats, 3)
    assert s[2] > 1.5 * s[3]
    assert np.allclose(basis.T @ basis, np.eye(3), atol=1e-8)
    assert np.linalg.norm(basis @ basis.T @ want - want, 2) < 1e-3  # the sine of the largest angle between the spaces


def test_a_paraphrase_is_found_that_hashing_misses(spark):
    df = spark.createDataFrame(corpus(), "id long, text string")
    model = latent.fit(df, "id", "text", width=3)
    cars = [(i, t) for i, t in corpus() if "car " in t + " " and "automobile" not in t]
    docs = spark.createDataFrame([(i, "car") if i == cars[0][0] else (i, t) for i, t in corpus() if i == cars[0][0] or i % 3], "id long, text string")
    asked = spark.createDataFrame([(1, "automobile")], "qid long, text string")
    found = {}
    for name, vectors in (("latent", lambda x: latent.with_vector(x, "text", model)), ("hashed", lambda x: with_hashed_vector(x, "text", 256))):
        hit = retrieve.vector_topk(vectors(docs), vectors(asked).select("qid", "embedding"), k=1).first()
        found[name] = (hit["id"], hit["score"])
    assert found["latent"][0] == cars[0][0] and found["latent"][1] > 0.9
    assert found["hashed"][1] == pytest.approx(0)


def test_vectors_of_odd_texts(spark):
    df = spark.createDataFrame([*corpus(60), (100, None), (101, ""), (102, "zzz unknown"), (103, "car")], "id long, text string")
    model = latent.fit(df.where("id < 100"), "id", "text", width=8)
    got = {r.id: np.array(r.embedding) for r in latent.with_vector(df, "text", model).collect()}
    assert all(len(v) == 8 for v in got.values())
    assert all(np.isclose(np.linalg.norm(v), 1) for i, v in got.items() if i < 100 or i == 103)
    assert not got[100].any() and not got[101].any() and not got[102].any()


def test_the_same_axes_however_rows_are_dealt(spark):
    df = spark.createDataFrame(corpus(), "id long, text string")
    one, two = (latent.fit(df.repartition(n), "id", "text", width=3).load(spark)[1] for n in (1, 5))
    assert np.allclose(np.abs((one * two).sum(axis=0)), 1, atol=1e-6)


def test_an_empty_corpus(spark):
    df = spark.createDataFrame([], "id long, text string")
    model = latent.fit(df, "id", "text", width=4)
    assert latent.with_vector(df, "text", model).collect() == []
