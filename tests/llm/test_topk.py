import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, size int, ids string"


def brute(rows, k, every):
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in fine:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in fine if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def check(spark, rows, k=10, every=5):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % every == 0, k=k).collect()) == brute(rows, k, every)


def test_ties_nulls_and_sizes(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 0.5, -0.5, 1.0]) for _ in range(4)], 1, 2, "x") for i in range(120)]
    rows += [(i, [0.25] * 4, 1, 2, None) for i in range(120, 160)]
    rows += [(200, None, 1, 1, "x"), (205, [1.0, None, 0.0, 0.0], 1, 1, "x"), (210, [float("nan")] * 4, 1, 1, "x"), (215, [float("inf"), 0.0, 0.0, 0.0], 1, 1, "x"),
             (220, [], 1, 1, "x"), (None, [1.0] * 4, 1, 1, "x"), (225, [1.0, 2.0], 1, 1, "x"), (226, [1.0, 2.5], 1, 1, "x"), (230, [3.0] * 3, 1, 1, "x")]
    check(spark, rows)
    check(spark, rows[:3], k=10)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.5], 0, 0, "")] * 3 + [(i, [0.1 * i, 1.0], 0, 0, "") for i in range(1, 12)] + [(7, [0.7, 1.0], 0, 0, "")] * 2
    check(spark, rows, k=4)


def test_large_numbers_stay_exact(spark):
    r = random.Random(3)
    check(spark, [(i, [r.uniform(-3e5, 3e5) for _ in range(6)], 0, 0, "") for i in range(60)], k=3)


def test_empty_and_no_query(spark):
    check(spark, [])
    check(spark, [(1, [1.0], 0, 0, ""), (2, [1.0], 0, 0, "")])


def test_shards_and_batches(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "BATCH", 7)
    rng = np.random.default_rng(4)
    check(spark, [(i, rng.normal(size=16).astype(np.float32).tolist(), 0, 0, "") for i in range(700)], every=10)


def test_bounds_shut_out_rows_before_the_lists_end():
    """Reading stops early where scores allow it."""
    rng = np.random.default_rng(5)
    x = rng.integers(-100, 100, (4096, 3))
    x[:20] += 4000
    lists = topk.Lists(x)
    (q, rows, scores), = lists.search(np.array([[5, 6, 7]]), 10, np.zeros((1, 4096), bool))
    assert len(rows) < 4096 and set(np.argsort(-(x @ [5, 6, 7]))[:10]) <= set(rows.tolist())
    assert (scores == x[rows] @ [5, 6, 7]).all()


def _given():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.floor(1024 * np.array(t["embedding"].to_pylist(), np.float32).astype(np.float64)).astype(np.int64)
    return t["vec_id"].to_numpy(), x


def test_reading_stops_before_the_ends_of_the_given_lists():
    ids, x = _given()
    lists, asked = topk.Lists(x), x[ids % 100 == 0]
    barred = ids[ids % 100 == 0][:, None] == ids[None, :]
    for q, rows, scores in lists.search(asked, 10, barred):
        exact = x @ asked[q]
        exact[barred[q]] = -(1 << 60)
        assert set(np.argsort(-exact, kind="stable")[:10]) <= set(rows.tolist()) and (scores == x[rows] @ asked[q]).all()
    assert len(lists.depths) == len(asked) and max(lists.depths) < len(x)


def test_a_floor_of_earlier_shards_shuts_out_rows():
    ids, x = _given()
    lists, asked, none = topk.Lists(x), x[:8], np.zeros((8, len(x)), bool)
    list(lists.search(asked, 10, none))
    free, lists.depths = lists.depths, []
    best = np.sort(asked @ x.T, axis=1)[:, -3].astype(float)
    for q, rows, scores in lists.search(asked, 10, none, best):
        assert set(np.flatnonzero(x @ asked[q] >= best[q])) <= set(rows.tolist())
    assert sum(lists.depths) < sum(free)


def test_bounds_of_the_unread_part():
    rng = np.random.default_rng(9)
    x, q = rng.integers(-50, 50, (60, 7)).astype(float), rng.integers(-50, 50, (4, 7))
    u, v = np.maximum(q, 0).T.astype(float), np.minimum(q, 0).T.astype(float)
    high, low = rng.random((60, 7)) < 0.5, rng.random((60, 7)) < 0.5
    left = (x * ~high) @ u + (x * ~low) @ v
    assert (np.abs(left) <= topk.Lists._unread(x, high, low, u, v)).all()


def test_no_copies_of_the_queries_on_the_driver(spark):
    """A broadcast would collect every batch once per group of shards, however small its file."""
    df = spark.createDataFrame([(i, [0.5, float(i)], 0, 2, "x") for i in range(40)], SCHEMA)
    plan = topk.search(df, F.col("vec_id") % 5 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
