"""Archives read back, the merged index, the loser tree."""

import gzip
import hashlib
import random

from tessera.llm import warc
from tessera.session import work_dir


def captures(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, run string, digest int")
    path = work_dir(spark, "test-archives")
    warc.write(df, path, **options)
    return path, warc.histories(warc.read(spark, path))


def brute(rows, least=100):
    first = {}
    for id_, _, html, *_ in rows:
        key = (html or "").encode()
        if len(key) >= least and id_ is not None:
            first[key] = min(first.get(key, id_), id_)
    out = []
    for id_, _, html, *_ in rows:
        key = (html or "").encode()
        to = first.get(key)
        to = None if to == id_ else to
        out.append((id_, len(key), hashlib.sha256(key).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip_and_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    r = random.Random(4)
    texts = ["", "short", "ü" * 50, "x" * 100, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 5, "é\x00\n" * 60, "y" * 5000]
    urls = [None, "", "http://www.Example.com:80/B?z=1&a=2#f", "https://example.com/a b%41", "http://[bad", "http://a.example.com/é", "no-host"]
    rows = [(r.choice([None, i, i, i, i // 2]), r.choice(urls), r.choice([None, *texts]), "c", 1) for i in range(200)]
    _, df = captures(spark, rows)
    got = df.collect()
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=repr) == brute(rows)
    assert sorted(x.place for x in got) == list(range(200))
    order = [(x.url_key.encode(), x.captured, x.page_id is None, x.page_id or 0) for x in sorted(got, key=lambda x: x.place)]
    assert order == sorted(order)
    assert {x.url for x in got} <= set(urls)
    assert len({x.archive for x in got}) > 4


def test_archives_are_warc(spark):
    path, df = captures(spark, [(7, "http://x.org/p", "<p>" + "é" * 60, "", 0), (9, "http://x.org/q", "<p>" + "é" * 60, "", 0)])
    files = spark.read.format("binaryFile").load(path + "/*/*.gz").collect()
    raw = gzip.decompress(files[0].content)
    for x in df.collect():
        found = [gzip.decompress(f.content)[x.offset:x.offset + x.length] for f in files if f"archive={x.archive}/" in f.path]
        head = found[0].split(b"\r\n\r\n")[0].decode().split("\r\n")
        assert head[0] == "WARC/1.1" and f"WARC-Type: {x.record_type}" in head and f"WARC-Record-ID: <urn:page:{x.page_id}>" in head
        assert (b"<p>" in found[0]) == (x.record_type == "response")
    assert raw.endswith(b"\r\n\r\n")
    assert {(x.page_id, x.refers_to) for x in df.collect()} == {(7, None), (9, 7)}


def test_empty_table(spark):
    path, df = captures(spark, [])
    assert df.collect() == []


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/B?z=1&a=2#f") == "com,example)/b?a=2&z=1"
    assert warc.url_key("https://u:p@a.example.com:8080") == "com,example,a:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_loser_tree_and_passes():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 100):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)
    rows = [(f"{i:03}", 0, f"k{r.randrange(30)}", f"t{r.randrange(5)}", r.choice([None, r.randrange(100)])) for i in range(150) for _ in range(r.randrange(600))]
    runs = {}
    for row in rows:
        runs.setdefault(row[0], []).append(row)
    spread = [row for run in runs.values() for row in sorted(run, key=warc._order)]
    merged = list(warc.merge_runs(iter(spread), fan=4))
    assert [warc._order(x) for x in merged] == sorted(map(warc._order, rows))
    assert sorted(merged, key=repr) == sorted(rows, key=repr)
