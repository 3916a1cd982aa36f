import re
from collections import Counter, defaultdict

from odd import frame, rows
from tessera.llm import mixing

WORDS = r"[^\x20\x09-\x0D]+"


def water(sizes, weights=(3, 1, 2), epochs=1.5, most=2):
    """Targets by refilling until no source is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        rest = [s for s in order if s not in full]
        share = (epochs * sum(sizes.values()) - sum(full.values())) / max(1, sum(weight[s] for s in rest))
        above = [s for s in rest if share * weight[s] > most * sizes[s]]
        if not above:
            return full | {s: share * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in above}


def check(got, docs):
    size = {}
    for _, text, _, source, *_ in docs:
        size[source] = size.get(source, 0) + len(re.findall(WORDS, text or ""))
    targets = water(size)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return {s: (taken[s], targets[s], largest[s]) for s in size}


def test_odd_rows(spark):
    got = mixing.mix(frame(spark)).collect()
    check(got, rows())
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((d[0], len(re.findall(WORDS, d[1] or ""))) for d in rows()), key=repr)
    assert mixing.mix(frame(spark).limit(0)).collect() == []


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = mixing.mix(docs).collect()
    near = check(one, [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    assert all(abs(a - t) <= max(0.03 * t, 2 * big) for a, t, big in near.values())
    assert abs(sum(a for a, _, _ in near.values()) / sum(t for _, t, _ in near.values()) - 1) < 0.01
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, again))


def test_copies_follow_the_prefix_sums(spark):
    """Within a source, copies of the first n documents differ from n times the expectation by less than one."""
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    for source, each in (("a", 1.5), ("b", 1.5)):
        got = [r for r in mixing.mix(df, weights=(1, 1)).collect() if r.source == source]
        each = got[0].target / got[0].source_size
        assert abs(sum(r.copies for r in got) - each * len(got)) < 1
        for size in {r.size for r in got}:
            part = [r.copies for r in got if r.size == size]
            assert abs(sum(part) - each * len(part)) < 2 and set(part) <= {int(each), int(each) + 1}


def test_mixed_rows(spark):
    df = frame(spark)
    got = mixing.mixed(df)
    assert got.columns == df.columns
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, len(re.findall(WORDS, r.text or ""))) for r in got.collect()) == +want
