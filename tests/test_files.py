import os

from tessera.plans import ingest
from tessera.sources import files as FS


def test_folder_scan_and_chunks(spark, tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("hello world")
    (d / "c.CSV").write_text('h1,h2\n1,"q""t"\n2,x\n')
    (d / "sub" / "b.txt").write_text("nested")
    (d / "_h.txt").write_text("hidden")
    (d / ".d.txt").write_text("hidden")
    (d / "bad.txt").write_bytes(b"\x61\xff")
    (d / "p.pdf").write_bytes(b"%PDF")
    (d / "t.xlsx").write_bytes(b"zip")
    (d / "bad.csv").write_bytes(b"a,b\n\xff,2\n")
    (d / "blank.csv").write_bytes(b"\xef\xbb\xbfa,b\r\n\r\n \t\n1,2\n\n")
    chunks, rejects = ingest.folder_chunks(spark, str(d), decoders={"pdf": lambda b: "pdf text", "xlsx": lambda b: "h1,h2\n1,2\n"})
    got = sorted((r["name"], r["kind"], r["chunk"]) for r in chunks.collect())
    assert got == [
        ("a.txt", "text", "hello world"),
        ("blank.csv", "table", "blank.csv\n\na,b\n1,2"),
        ("c.CSV", "table", 'c.CSV\n\nh1,h2\n1,"q""t"\n2,x'),
        ("p.pdf", "pdf", "pdf text"),
        ("t.xlsx", "table", "t.xlsx\n\nh1,h2\n1,2"),
    ]
    assert sorted((r["name"], r["error"]) for r in rejects.collect()) == [("bad.csv", "invalid UTF-8"), ("bad.txt", "invalid UTF-8")]


def test_decoder_failure_is_rejected(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    (d / "x.docx").write_bytes(b"zz")
    scanned = FS.scan_folder(spark, str(d))

    def boom(b):
        raise ValueError("bad docx")

    out = FS.decode_with(scanned, {"docx": boom}).collect()
    assert out[0]["ok"] is False and "bad docx" in out[0]["error"] and out[0]["text"] == ""


def test_csv_render_doubles_quotes(spark):
    df = spark.createDataFrame([('q"t', "b")], "a string, b string")
    assert FS.csv_render(df).first()["row"] == '"q""t",b'


def test_documents_are_laid_out_in_few_folders(spark):
    """A folder per file is moved by the driver one by one, and a task per 32 small files is most of a scan."""
    odd = ["_h.txt", ".d.txt", "a+b c.txt", "x/y%41.txt", "é:*.txt", None, ""]
    rows = [(f"doc_{i}.txt", f"text {i}") for i in range(600)] + [(n, "odd") for n in odd] + [("twice.txt", "b"), ("twice.txt", "a"), ("null.txt", None)]
    path = ingest.write_documents_as_files(spark.createDataFrame(rows, "f string, text string"))
    local = path.removeprefix("file:")
    assert len(os.listdir(local)) <= ingest.FOLDERS and not [f for _, _, fs in os.walk(local) for f in fs if f.startswith((".", "_"))]
    scanned = FS.scan_folder(spark, path, recursive=True)
    got = {r["name"]: bytes(r["content"]).decode() for r in scanned.collect()}
    want = {n: f"{t}\n" for n, t in rows if n and n not in ("twice.txt", "null.txt")}
    assert got == want | {"__HIVE_DEFAULT_PARTITION__": "odd\nodd\n", "twice.txt": "a\nb\n", "null.txt": "\n"}
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    with FS.small_files(spark):
        assert FS.scan_folder(spark, path, recursive=True).rdd.getNumPartitions() <= 8
    assert spark.conf.get("spark.sql.files.openCostInBytes") == was
    assert FS.scan_folder(spark, ingest.write_documents_as_files(spark.createDataFrame([], "f string, text string")), recursive=True).count() == 0


def test_tasks_list_and_read_the_folders(spark, tmp_path):
    """The driver lists no folder but the first: a status per file would grow with the files."""
    from tessera.sources import files

    held = {"a.txt": b"one", "x/b%20c.csv": b"1,2", "x/y/z/d.tar.gz": b"no gzip", "x/y/z/empty.txt": b"", "x/y/f=q.txt/part": b"p", "w/\u00fc \u00df.txt": b"\xff\x00",
            "_part=1/e.txt": b"e", "_hidden.txt": b"h", ".dot/k.txt": b"k", "x/_more/l.txt": b"l", "x/.m.txt": b"m", "x/_SUCCESS": b""}
    for name, raw in held.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "empty").mkdir()
    columns = ("path", "name", "ext", "kind", "length", "content")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = files.scan_folder(spark, path, recursive=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and "MapInArrow" in plan
        want = files.with_kind(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
        rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
        assert rows == sorted(tuple(r[c] for c in columns) for r in want.collect()) and len(rows) == 6
    assert files.scan_folder(spark, str(tmp_path / "empty"), recursive=True).collect() == []
