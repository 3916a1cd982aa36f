"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256, kept) of each text."""
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def digest_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return sorted((tuple(r) for r in repeats.digest(df, **options).collect()), key=repr)


def expected(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    return sorted(((r[0], *b) for r, b in zip(rows, brute(texts, length), strict=True)), key=repr)


def corpus(seed, alphabet="ab c", docs=60):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [word(n) for n in (25, 40, 90)]
    out = []
    for i in range(docs):
        parts = [word(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            if r.random() < 0.4:  # a copy with an edit
                k = r.randrange(len(s))
                s = s[:k] + r.choice(alphabet) + s[k + 1:]
            parts += [s, word(r.randint(0, 20))]
        out.append((i, "".join(parts), "x"))
    return out


@pytest.mark.parametrize(("seed", "alphabet", "limit", "widths"), [
    (1, "abcdefgh é", 512, (4, 1)), (2, "ab", 3, (4, 1)), (3, "abcdefghijkl", 2, (5, 1)), (4, "a", 512, (4, 1)), (5, "abcdefgh", 2, (1,)),
    (6, "abc", 2, (9, 3, 1)), (7, "abcdefgh", 1, (11, 6, 3, 2, 1))])
def test_equals_brute_force(spark, seed, alphabet, limit, widths):
    rows = corpus(seed, alphabet)
    got = digest_rows(spark, rows, length=20, gram=8, limit=limit, widths=widths)
    assert got == expected(rows, 20)


def test_nulls_repeats_ties_and_empty(spark):
    long = "".join(random.Random(9).choice("abcdefgh") for _ in range(50))
    rows = [(1, None, "x"), (2, "", None), (None, long, None), (None, long, None), (3, "short", "x"), (3, "short", "x"), (4, "ab" * 40, "x")]
    assert digest_rows(spark, rows, length=20, gram=8) == expected(rows, 20)
    assert digest_rows(spark, [], length=20, gram=8) == []


def test_production_length_in_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in repeats.digest(docs).collect()), key=repr) == expected(rows, repeats.LENGTH)


def test_very_long_text(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, base + base[1000:3000], "x"), (2, base[70_000:70_399], "x"), (3, base[90_000:90_400], "x")]
    got = dict((x[0], x[1:4]) for x in digest_rows(spark, rows))
    assert got == {1: (202_000, 4400, 3), 2: (399, 0, 0), 3: (400, 400, 1)}


def test_strip_keeps_columns_and_whole_characters(spark):
    """Columns named like the operator's own, a cut inside of a character, null texts."""
    same = "é" + "abcdefghijklmnopqrs"
    df = spark.createDataFrame([(1, "Aü" + same + "ü1", 5, "r"), (2, "Bü" + same + "ü2", 6, None), (3, None, None, "r")],
                               "doc_id long, text string, n_chars int, row string").withColumnRenamed("row", "marks")
    got = sorted(tuple(r) for r in repeats.strip(df, length=20, gram=8).collect())
    assert got == [(1, "A1", 2, "r"), (2, "B2", 2, None), (3, None, None, "r")]
    half = spark.createDataFrame([(1, "ãaaaaabbbbbcccccddddde", 0), (2, "ӣaaaaabbbbbcccccddddd!", 0)], "doc_id long, text string, n_chars int")
    assert [r.text for r in repeats.strip(half, length=20, gram=8).orderBy("doc_id").collect()] == ["ãe", "ӣ!"]


def test_anchors_hold_every_window():
    text = np.random.default_rng(1).integers(0, 4, 300_000).astype(np.uint8).tobytes()
    at = repeats.anchors(text, 400, 128)
    assert (np.diff(np.concatenate([[-1], at])) <= 273).all() and len(text) - at[-1] <= 400
    # content alone decides, wherever a block starts
    moved = repeats.anchors(text[1234:], 400, 128)
    assert set(moved + 1234) >= {a for a in at if a >= 1234 + 273}


@pytest.mark.parametrize("widths", [(4, 1), (9, 4, 2, 1), (11, 5, 2, 1), (11, 6, 3, 2, 1)])
def test_hot_anchors_a_width_apart(spark, widths):
    """A stretch of one anchor is the next stretch of the other: its windows stand in
    one task under two keys, at every level of the chain."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passages = [word(19) for _ in range(90)]  # no window of 20 bytes fits into one
    apart = np.concatenate([np.diff(repeats.anchors((word(20) + p + word(20)).encode(), 20, 8)) for p in passages])
    assert set(widths[:-1]) <= set(apart.tolist())
    rows = [(i, word(20) + passages[i % 90] + word(20), "x") for i in range(900)]
    rows += [(900 + i, rows[i][1][:30] + word(9), "x") for i in range(0, 900, 50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = digest_rows(spark, rows, length=20, gram=8, limit=3, widths=widths)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected(rows, 20)


def test_long_chain_deals_few_rows(spark):
    """One passage in many different texts: whatever the level, a string gives a few rows."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage = word(700)
    rows = [(i, word(300) + passage[r.randint(0, 50):700 - r.randint(0, 50)] + word(300), "x") for i in range(400)]
    assert digest_rows(spark, rows, limit=64) == expected(rows, repeats.LENGTH)
    with pytest.raises(ValueError, match="widths"):
        digest_rows(spark, rows[:1], widths=(4, 9, 1))
