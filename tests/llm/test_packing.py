from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from odd import frame, rows
from tessera.llm import packing
from test_tokens import crc, want


def sequences(plan_rows, histogram):
    """Pieces of each sequence from the runs."""
    out = defaultdict(list)
    rows_ = plan_rows.tolist()
    for k, (size, rank, sequence, offset) in enumerate(rows_):
        stop = rows_[k + 1][1] if k + 1 < len(rows_) and rows_[k + 1][0] == size else histogram[size]
        for i in range(stop - rank):
            out[sequence + i].append((offset, size))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_without_gaps_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(3 + seed / 2, 1, 3000).astype(int) + 1, 1, 512)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    plan_rows, n = packing.plan(histogram, 512)
    seqs = sequences(plan_rows, histogram)
    assert set(seqs) == set(range(n))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))]
        assert sum(s for _, s in parts) <= 512
    bound = max(-(-int(lengths.sum()) // 512), int((lengths > 256).sum()))
    assert n <= bound * 1.02 + 2


@pytest.mark.parametrize("seed", range(3))
def test_the_program_places_most_pieces(seed):
    """Its value is near the dual bound, and rounding loses no sequence against best fit alone."""
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5, 1.2, 6000).astype(int) + 1, 1, 1023)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    report = {}
    _, n = packing.plan(histogram, 1024, report)
    some, counts = (np.array(x, np.int64) for x in zip(*sorted(histogram.items()), strict=True))
    assert report["placed"] >= 0.6 * report["pieces"] == 0.6 * 6000
    assert report["value"] + packing.GAP * lengths.sum() / 1024 <= report["bound"] * (1 + 2 * packing.GAP) + 1
    assert report["bound"] <= n + 1e-9 and n <= sum(k for _, k in packing.best_fit(some, counts, 1024)) + 1


def test_rounding_uses_no_piece_twice():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 9, 12)
    used = {tuple(sorted(rng.integers(0, 12, 3).tolist())): float(rng.random()) for _ in range(60)}
    used = {f: min(x, *(counts[i] / 40 for i in f)) for f, x in used.items()}
    fillings, left = packing.rounded(used, counts)
    again = counts.copy()
    for f, n in fillings:
        np.subtract.at(again, list(f), n)
    assert (again == left).all() and (left >= 0).all()


def test_known_optimum():
    assert packing.plan({6: 30, 4: 30, 5: 20}, 10)[1] == 40
    assert packing.plan({7: 10, 3: 10}, 10)[1] == 10
    assert packing.plan({10: 3}, 10)[1] == 3 and packing.plan({}, 10)[1] == 0
    assert packing.plan({44: 2, 6: 6, 24: 4, 26: 2}, 100)[1] == 3  # 44 + 26 + 24 + 6 twice


def test_knapsack_is_best():
    lengths, prices = np.array([2, 3, 5]), np.array([2.0, 3.5, 5.6])
    best, first = packing.knapsack(lengths, prices, 9)
    for room in range(10):
        brute = max(2.0 * a + 3.5 * b + 5.6 * c for a in range(5) for b in range(4) for c in range(2) if 2 * a + 3 * b + 5 * c <= room)
        assert abs(best[room] - brute) < 1e-9
        assert abs(sum(prices[packing.fill(room, first.tolist(), lengths.tolist())]) - brute) < 1e-9


def test_pieces_of_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(frame(spark), path, end_id=1, capacity=64).collect()
    expected = [(i, k, s, len(ids[s:s + 64]), crc(ids[s:s + 64])) for i, ids in want(rows(), "word_bpe_49k.json", 1) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))] and sum(s for _, s in parts) <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(frame(spark).limit(0), path).collect() == []
