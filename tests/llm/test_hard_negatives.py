"""Hard negatives against all scores."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, size int, ids string, anchor int, block int"


def brute(rows, every, relabel=7, k=5):
    fine = [(i, None if i % relabel else (label + 1) % 10, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label, *_ in rows
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, label if new is None else new, v) for i, new, label, v in fine]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in fine:
        if i % every == 0:
            scored = sorted((-dot(v, w), j, other) for j, other, w in fine if len(w) == len(v))
            for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:k]:
                hard = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
                out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def check(spark, rows, every=5):
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, label=label())
    want = brute(rows, every)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_ties_nulls_and_sizes(spark):
    r = random.Random(2)
    rest = (1, "x", 2, 3)
    rows = [(i, [r.choice([0.0, 0.5, -0.5, 1.0]) for _ in range(4)], r.randrange(4), *rest) for i in range(150)]
    rows += [(i, [0.25] * 4, i % 3, *rest) for i in range(150, 180)]
    rows += [(200, None, 1, *rest), (205, [1.0, None, 0.0, 0.0], 1, *rest), (210, [float("nan")] * 4, 1, *rest), (215, [float("inf"), 0.0, 0.0, 0.0], 1, *rest),
             (220, [], 1, *rest), (None, [1.0] * 4, 1, *rest), (225, [1.0, 2.0], 1, *rest), (226, [1.0, 2.5], 1, *rest), (227, [1.0, 2.0], 2, *rest),
             (230, [3.0] * 3, None, *rest), (235, [-1.0] * 4, 3, *rest), (240, [0.0] * 4, 2, *rest)]
    assert check(spark, rows)
    check(spark, rows[:3])


def test_repeated_rows(spark):
    rest = (1, None, 2, 3)
    rows = [(0, [1.0, 0.5], 0, *rest)] * 3 + [(i, [0.9 + 0.01 * i, 0.5], i % 2, *rest) for i in range(1, 14)] + [(9, [1.0, 0.45], 1, *rest)] * 2
    assert check(spark, rows)


def test_one_hot_label_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 17))
    rows = [(i, (centres[i % 3] + 0.4 * rng.normal(size=17)).astype(np.float32).tolist(), 0 if i % 3 else i % 5, 1, "", 2, 3) for i in range(900)]
    assert check(spark, rows, every=20)
    monkeypatch.setattr(H, "ROWS", 64)
    monkeypatch.setattr(H, "QUERIES", 7)
    assert check(spark, rows, every=20)


def test_large_numbers_stay_exact(spark):
    r = random.Random(3)
    base = [r.uniform(1e5, 3e5) for _ in range(6)]
    rows = [(i, [x * r.uniform(0.9, 1.1) for x in base], i % 3, 0, "", 2, 3) for i in range(60)]
    assert check(spark, rows)


def test_empty_and_no_anchor(spark):
    check(spark, [])
    check(spark, [(1, [1.0], 0, 0, "", 2, 3), (2, [1.0], 1, 0, "", 2, 3)])


def test_bounds_hold_every_score():
    rng = np.random.default_rng(6)
    for size in (1, 2, 5, 16, 33):
        x, q = rng.integers(-300, 300, (200, size)), rng.integers(-300, 300, (1, size))
        exact = x @ q[0]
        wide = [np.inf] * 200
        for (a, b), (qa, qb) in zip(H.summaries(x), H.summaries(q), strict=True):
            middle, spread = a @ qa[0], b @ qb[0]
            assert (np.abs(exact - middle) <= spread + 1e-6).all()
            assert (spread <= np.array(wide) + 1e-6).all()  # a finer level is never looser
            wide = spread


def test_finer_levels_see_fewer_rows():
    """Rows of smooth vectors are shut out before they are scored."""
    rng = np.random.default_rng(7)
    x = (1000 * np.repeat(rng.normal(size=(4000, 4)), 8, axis=1) + rng.normal(size=(4000, 32))).astype(np.int64)
    block = H.Block(np.arange(4000), np.zeros(4000, np.int64), x, H.summaries(x))
    q = x[:1]
    looked = np.zeros(len(block.stored) + 1, np.int64)
    (no, rows, scores), = block.search(np.arange(1, 4000), q[0], [(a[0], b[0]) for a, b in H.summaries(q)], [(-1 << 62, 1 << 62)], [-1 << 62], 5, looked)
    assert set(np.argsort(-(x[1:] @ q[0]))[:5] + 1) <= set(rows.tolist()) and no == 0
    assert (scores == x[rows] @ q[0]).all()
    assert looked[0] == 3999 and looked[-1] < 100 and (np.diff(looked) <= 0).all()


def test_no_copies_of_the_queries_on_the_driver(spark):
    """A broadcast would collect every block of queries once per group of blocks, however small its file."""
    df = spark.createDataFrame([(i, [0.5, float(i)], i % 3) for i in range(40)], "vec_id long, embedding array<float>, label int")
    rows = H._packed(H.quantised(df).select("vec_id", "label", "v", F.lit(0).alias("none")), 16, "none", "int")
    ask = "struct<anchor: bigint, windows: array<struct<low: bigint, high: bigint>>>"
    one = F.struct("vec_id", F.array(F.struct(F.lit(0).alias("low"), F.lit(9).alias("high")))).cast(ask)
    asked = H._packed(H.quantised(df).select("vec_id", "label", "v", one.alias("asked")), 16, "asked", ask)
    plan = H._search(rows, asked, True, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
