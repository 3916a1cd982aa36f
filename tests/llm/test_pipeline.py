"""Each stage on its own input, and the whole run, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from odd import frame
from tessera.llm.queries import QUERIES, SQL
from tessera.session import materialize
from test_repeats import brute as brute_repeats
from test_rules import brute as brute_rules
from test_simhash import brute as brute_simhash

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        after = [tuple(r) for r in docs.collect()]
        seen[name] = (before, after)
        if name != "pack_sequences":
            assert docs.columns == columns
        before = after
    first, good = seen["quality_rules"]
    assert set(good) <= {r for r in first if not brute_rules(r[1])[-1]} and len(good) > 0.7 * len(first)
    given, unique = seen["simhash_dedup"]
    keep = {c for _, _, c in brute_simhash([r[:2] for r in given])}
    assert sorted(r[0] for r in unique) == sorted(keep) and set(unique) <= set(given)
    given, stripped = seen["repeated_passages"]
    left = {r[0]: r for r in stripped}
    for r, (size, gone, *_) in zip(given, brute_repeats([r[1].encode() for r in given], corpus_pipeline.PASSAGE), strict=True):
        kept = len(left[r[0]][1].encode())
        assert size - gone <= kept <= size - gone + 6 * (gone > 0)
        assert left[r[0]][4] == len(left[r[0]][1])
    given, mixed = seen["mix_sources"]
    assert set(mixed) <= set(given) and max(Counter(mixed).values()) <= 2
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows)
    assert abs(words(mixed) / words(given) - 1.5) < 0.15
    given, packed = seen["pack_sequences"]
    assert Counter(r[0] for r in packed if r[1] == 0) == Counter(r[0] for r in given)


def test_stages_on_odd_rows(spark):
    docs = frame(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = materialize(stage(spark, docs, SF), name)
        assert k == 4 or got.columns == docs.columns
        assert got.count() or name == "quality_rules"
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == []


def test_registered(spark):
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5
