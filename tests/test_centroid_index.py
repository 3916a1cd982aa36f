import numpy as np
import pytest

from given import SF_SMALL
from tessera.operators import centroid_index, retrieve
from tessera.sources.tables import load


def _frame(spark, x, first=0, names="id long, embedding array<double>"):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], names)


def _rows(df, ids=("id",)):
    return sorted((r["qid"], r["rank"], *(r[c] for c in ids), r["score"]) for r in df.collect())


def _clusters(n, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(20, dims))[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, dims))


def test_all_lists_give_the_exact_result(spark, monkeypatch):
    monkeypatch.setattr(centroid_index, "QUESTIONS", 7)
    corpus = _frame(spark, _clusters(500))
    questions = _frame(spark, _clusters(40, seed=2), 1000, "qid long, embedding array<double>")
    index = centroid_index.build(corpus.repartition(5))
    exact = retrieve.vector_topk(corpus, questions)
    assert _rows(centroid_index.topk(index, questions, probes=None)) == _rows(exact)
    few = centroid_index.topk(index, questions, probes=3)
    assert centroid_index.recall(few, exact, ["id"]) >= 0.9
    assert len(_rows(centroid_index.topk(index, questions, k=600, probes=1))) < 0.5 * 40 * 500  # one list of many


def test_every_row_is_in_one_block(spark):
    corpus = _frame(spark, _clusters(300))
    index = centroid_index.build(corpus, lists=9)
    held = [i for r in index.lists(spark).collect() for i in r["id"]]
    assert sorted(held) == list(range(300))
    assert sum(r["n"] for r in index.centroids(spark).collect()) == 300 and index.centroids(spark).count() == 9


def test_a_hot_list_is_split(spark, monkeypatch):
    """Most rows alike: their list has many blocks and salts."""
    monkeypatch.setattr(centroid_index, "BLOCK", 16)
    monkeypatch.setattr(centroid_index, "SPLIT", 2)
    x = np.concatenate([np.ones((400, 6)) + 1e-3 * np.random.default_rng(3).normal(size=(400, 6)), _clusters(100, 6)])
    corpus = _frame(spark, x)
    questions = _frame(spark, x[390:410], 1000, "qid long, embedding array<double>")
    index = centroid_index.build(corpus, lists=4)
    assert max(r["salts"] for r in index.centroids(spark).collect()) > 1
    assert _rows(centroid_index.topk(index, questions, probes=None)) == _rows(retrieve.vector_topk(corpus, questions))


def test_recall_on_the_given_vectors(spark):
    vectors = load(spark, SF_SMALL, "embeddings").selectExpr("vec_id as id", "embedding")
    questions = vectors.withColumnRenamed("id", "qid")
    exact = retrieve.vector_topk(vectors, questions, exclude_self=True)
    index = centroid_index.build(vectors)
    found = centroid_index.topk(index, questions, exclude_self=True)
    assert centroid_index.recall(found, exact, ["id"]) >= 0.9


def test_probes_are_calibrated():
    """Well parted clusters need few lists, vectors without structure many."""
    x, noise = _clusters(2000), np.random.default_rng(5).normal(size=(2000, 24))
    few, many = (centroid_index.calibrated(s, centroid_index.fit(s, 40), 3, 0.95) for s in (x, noise))
    assert few < many / 2 <= 20


def test_copies_zero_vectors_and_several_ids(spark):
    rows = [(i % 3, i, [1.0, 0.0]) for i in range(30)] + [(7, 0, [0.0, 0.0]), (8, 0, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "source_id long, chunk_no long, embedding array<double>")
    questions = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 0.0])], "qid string, embedding array<double>")
    ids = ["source_id", "chunk_no"]
    index = centroid_index.build(corpus, ids)
    assert _rows(centroid_index.topk(index, questions, probes=None), ids) == _rows(retrieve.vector_topk(corpus, questions, ids), ids)


def test_empty_sides(spark):
    corpus = _frame(spark, _clusters(20))
    questions = corpus.withColumnRenamed("id", "qid")
    assert centroid_index.topk(centroid_index.build(corpus.limit(0)), questions).collect() == []
    assert centroid_index.topk(centroid_index.build(corpus), questions.limit(0)).collect() == []


def test_fit_uses_every_centroid():
    x = np.repeat(np.eye(3), 50, axis=0)
    c = centroid_index.fit(x, 10)
    assert sorted(map(tuple, np.round(c, 6))) == sorted(map(tuple, np.eye(3)))
    with pytest.raises(ValueError):
        centroid_index.fit(np.zeros((0, 3)), 2)


def test_the_driver_holds_no_table_of_all_scores():
    """Fitting and calibration hold little beside the sample, whatever its size."""
    import tracemalloc

    x = np.random.default_rng(6).normal(size=(20_000, 8))
    tracemalloc.start()
    probes = centroid_index.calibrated(x, centroid_index.fit(x, 60), 3, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < probes <= 60 and peak < 60 << 20  # 1,024 x 20,000 scores are 160 MB


def test_a_question_is_not_copied_per_list(spark):
    """However many lists are probed: a question is in one block, with the numbers of its lists."""
    corpus = _frame(spark, _clusters(300))
    questions = _frame(spark, _clusters(40, seed=2), 1000, "qid long, embedding array<double>")
    index = centroid_index.build(corpus, lists=30)
    for probes in (3, 29, None):
        plan = centroid_index.topk(index, questions, probes=probes)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "explode(lists" not in plan
    some, exact = (centroid_index.topk(index, questions, probes=p) for p in (29, None))
    assert centroid_index.recall(some, exact, ["id"]) > 0.9
