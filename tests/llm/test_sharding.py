"""Proportional interleaving against a plain version of it."""

import hashlib
import zlib
from collections import Counter, defaultdict

from odd import frame, rows
from tessera.llm import sharding


def draw(*parts):
    return int(hashlib.md5("/".join(parts).encode()).hexdigest()[:13], 16)


def brute(docs, shards=8, seed="shards"):
    """(doc_id, size, crc, shard, slot) of (doc_id, text, source), sorted."""
    by_source = defaultdict(list)
    for doc_id, text, source in docs:
        b, i = (text or "").encode(), "" if doc_id is None else str(doc_id)
        crc, size = zlib.crc32(b), len(b) + 1
        by_source["-" if source is None else "+" + source].append((draw(seed, i, str(crc), str(size)), doc_id, size, crc))
    every = []
    for k, part in by_source.items():
        offset = (draw(seed, "source", k) + 0.5) / float(1 << 52)
        part.sort(key=lambda r: (r[0], r[1] is not None, str(r[1])))
        every += [((rank - offset) / len(part), k, rank, r) for rank, r in enumerate(part, 1)]
    every.sort(key=lambda x: x[:3])
    out, n = [], len(every)
    for place, (*_, (_, doc_id, size, crc)) in enumerate(every):
        s = place * shards // n
        out.append((doc_id, size, crc, s, place - -(-s * n // shards)))
    return sorted(out, key=repr)


def got(df, **options):
    r = sharding.shard(df, **options).collect()
    assert all(x.law == "rows" and x.grown_shard is None for x in r)
    return sorted(((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in r), key=repr)


def laws(out, shards=8):
    slots = defaultdict(list)
    for _, _, _, s, slot in out:
        slots[s].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(out)


def test_odd_rows_and_empty(spark):
    df = frame(spark)
    out = got(df)
    laws(out)
    assert out == brute([(r[0], r[1], r[3]) for r in rows()])
    assert got(df.limit(0)) == [] and len(got(df.limit(3))) == 3
    laws(got(df, shards=5), 5)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    out = got(docs)
    laws(out)
    given = [tuple(r) for r in docs.collect()]
    assert out == brute(given)
    assert out == got(docs.repartition(7))
    assert [x[3:] for x in out] != [x[3:] for x in got(docs, seed="other")]


def test_every_shard_matches_the_mixture(spark):
    """One source with most rows, middling ones, and many sources of one row each."""
    docs = [(i, "t" * (i % 50), "hot" if i % 3 else f"m{i % 4}") for i in range(3000)] + [(3000 + i, "x", f"one{i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    source, share = {i: s for i, _, s in docs}, Counter(s for *_, s in docs)
    seen = Counter((source[i], s) for i, _, _, s, _ in got(df))
    for name, n in share.items():
        if n > 1:
            assert all(abs(seen[name, s] - n / 8) <= 15 for s in range(8))
    ones = Counter(s for (name, s), n in seen.items() if name.startswith("one"))
    assert all(25 <= ones[s] <= 75 for s in range(8))


def test_more_sources_than_go_to_every_task(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    want = got(docs)
    monkeypatch.setattr(sharding, "SOURCES", 3)
    assert got(docs) == want


def test_rows_that_all_share_one_hash(spark):
    docs = [(7, "same", "a")] * 500 + [(i, "x", "b") for i in range(40)]
    out = got(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    laws(out)
    assert out == brute(docs)


def test_large_ids_stay_exact(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "a", "s"), (None, "b", "s")], "doc_id long, text string, source string")
    assert {x[0] for x in got(df)} == {big, None}


def test_written_shards(spark, tmp_path):
    df = frame(spark)
    sharding.write(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.row.doc_id, zlib.crc32((r.row.text or "").encode())) for r in back.collect()) == want
    assert back.select("row.*").columns == df.columns
    places = {(x[0], x[2]): x[3] for x in got(df, shards=4) if x[0] == 7}
    assert {(r.row.doc_id, zlib.crc32(r.row.text.encode())): r.shard for r in back.where("row.doc_id = 7").collect()} == places
    for s in range(4):
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))
