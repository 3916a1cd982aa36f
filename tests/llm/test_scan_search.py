"""Ranked search by an automaton against a plain count of every term."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from odd import frame, rows
from tessera.llm import scan_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score), sorted."""
    split = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs]
    held = [(i, c) for i, c in split if c]
    total, size = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        words = sorted(set(TERM.findall((text or "").translate(SMALL))))
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * total) // size
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=50):
    got = scan_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_terms_and_borders(spark):
    docs = [(1, "Mit mit-license mitten mit"), (2, "xmit MIT_x é mité"), (3, "ÉMIT émit 日本語 mit"), (4, "a a a b"), (5, "A B"), (6, "mit\x00mit\x7fmit"), (7, None), (8, "--")]
    items = [(1, "mit"), (2, "É 日本語 émit"), (3, "a b b"), (4, "none of these"), (5, ""), (6, None), (7, "mitten mit mit Mit")]
    check(spark, docs, items)


def test_ties_repeats_nulls(spark):
    docs = [(i, "red green blue") for i in range(9, 0, -1)] * 2 + [(None, "red green blue")] * 2 + [(50, "red red"), (51, "grey " * 300 + "red")]
    check(spark, docs, [(1, "red"), (1, "red"), (None, "green red"), (2, "grey")], k=5)
    check(spark, docs, [(1, "red blue")], k=100)


def test_empty_tables(spark):
    check(spark, [], [(1, "x")])
    check(spark, [(1, "x")], [])
    check(spark, [(1, None)], [(1, None)])
    check(spark, [(1, "")], [(1, "x")])


def test_odd_rows(spark):
    df = frame(spark)
    items = frame(spark).withColumnRenamed("doc_id", "item_id")
    got = sorted(map(tuple, scan_search.search(df, items, 3).collect()), key=repr)
    assert got == brute([r[:2] for r in rows()], [r[:2] for r in rows()], 3)


@pytest.mark.parametrize("pairs", [1 << 17, 300])
def test_table_in_one_and_many_blocks(spark, monkeypatch, pairs):
    monkeypatch.setattr(scan_search, "PAIRS", pairs)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    got = scan_search.search(docs, items)
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 1000


def test_best_keeps_the_first_of_equal_scores():
    rng = np.random.default_rng(3)
    best, every = scan_search.Best(4, 6), []
    for low in range(0, 4000, 100):
        scores, ids, null = rng.integers(0, 9, (100, 4)), rng.permutation(10_000)[:100], rng.integers(0, 2, 100)
        best.add(scores, ids, null)
        every += [(j, -int(scores[i, j]), int(null[i]), int(ids[i])) for i in range(100) for j in range(4) if scores[i, j] > 0]
    want = [r for j in range(4) for r in sorted(x for x in every if x[0] == j)[:6]]
    assert [(a, -b, c, d) for a, b, c, d in best.rows().T.tolist()] == want


def test_counts_equal_a_split_of_the_text():
    words = scan_search.Lexicon([[b"a", b"ab", b"b"], [b"ab", b"\xc3\xa9"]])
    n, no, tf = words.counts("a ab,b abab a é a-b".encode())
    assert n == 8 and dict(zip((words.words[i] for i in no), tf.tolist(), strict=True)) == {b"a": 3, b"ab": 1, b"b": 2, b"\xc3\xa9": 1}
