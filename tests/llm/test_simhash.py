import random
import re

import xxhash

from odd import frame, rows
from tessera.llm import simhash


def brute_fp(text, shingle=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(docs, bits=3):
    """Of each row: id, fingerprint, smallest id of its group, the group."""
    fps = [brute_fp(t) for _, t in docs]
    nodes = sorted(set(fps))
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(docs, fps, strict=True):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f)), find(f)) for (d, _), f in zip(docs, fps, strict=True)]


def brute(docs, bits=3):
    return sorted((r[:3] for r in brute_groups(docs, bits)), key=repr)


def test_odd_rows(spark):
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame(spark)).collect()), key=repr)
    assert got == brute([r[:2] for r in rows()])
    assert simhash.near_duplicates(frame(spark).limit(0)).collect() == []


def test_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute([tuple(r) for r in docs.collect()])


def test_links_equal_all_pairs(spark, monkeypatch):
    """Dense fingerprints: every table entry is shared, some by more than a block."""
    r = random.Random(6)
    centres = [r.getrandbits(64) for _ in range(12)]
    nodes = set()
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            nodes.add(x)
        nodes |= {c ^ (i << 33) for i in range(120)}  # one low half for all
    nodes = sorted(nodes)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in nodes], "fp long")
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(nodes):
        for j in range(i):
            if (a ^ nodes[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    want = {}
    for i, x in enumerate(nodes):
        want.setdefault(find(i), set()).add(signed(x))
    for block in (1024, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {}
        for row in simhash.components(simhash.links(df)).collect():
            got.setdefault(row.root, {row.root}).add(row.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_deduplicate_keeps_one_of_each_and_all_columns(spark):
    df = frame(spark)
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    groups = {}
    for d, _, _, group in brute_groups([r[:2] for r in rows()]):
        groups.setdefault(group, []).append(d)
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(x for x in g if x is not None) for g in groups.values())
