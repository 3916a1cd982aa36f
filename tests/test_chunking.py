import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking


def py_chunks(text, size=1000):
    cur, out = "", []
    for w in text.split():
        if len(cur) + len(w) + 1 > size:
            out.append(cur.strip())
            cur = w
        else:
            cur += " " + w
    if cur:
        out.append(cur.strip())
    return [c for c in out if c]


def spark_chunks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = chunking.chunk_words(df, "id", "text").collect()
    out = {i: [] for i in range(len(texts))}
    for r in sorted(got, key=lambda r: (r["id"], r["chunk_no"])):
        out[r["id"]].append(r["chunk"])
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("lengths,expect", [
    ([], []),
    ([1500, 1, 1], [1500, 3]),
    ([1, 1200, 1], [1, 1200, 1]),
    ([999, 1], [999, 1]),
    ([998, 1], [998, 1]),
    ([500, 498, 1], [999, 1]),
    ([500, 500, 499], [500, 1000]),
])
def test_word_packing_edges(spark, lengths, expect):
    text = " ".join("x" * n for n in lengths)
    got = spark_chunks(spark, [text])[0]
    assert [len(c) for c in got] == expect


def test_word_packing_separators(spark):
    text = "a\x1cb c\td  e"
    assert spark_chunks(spark, [text])[0] == ["a b c d e"]


def test_word_packing_random_equals_python(spark):
    rnd = random.Random(7)
    texts = [" ".join("w" * rnd.randint(1, 40) for _ in range(rnd.randint(0, 400))) for _ in range(30)]
    got = spark_chunks(spark, texts)
    assert got == [py_chunks(t) for t in texts]
    for t, cs in zip(texts, got):
        assert " ".join(cs).split() == t.split()
        assert all(len(c) <= 1000 or " " not in c for c in cs)


@pytest.mark.parametrize("n", [0, 3999, 4000, 4001, 8000])
def test_fixed_slices(spark, n):
    text = ("é" * n)
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = [r["slice"] for r in sorted(chunking.chunk_fixed(df, "id", "text").collect(), key=lambda r: r["slice_no"])]
    assert got == [text[i:i + 4000] for i in range(0, n, 4000)]
    assert "".join(got) == text


@pytest.mark.parametrize("size,parts", [(4000, 1), (4001, 2), (12000, 3), (0, 1)])
def test_even_split(spark, size, parts):
    df = spark.createDataFrame([(1, size)], "id long, n long")
    got = sorted(chunking.even_split(df, "id", "n", 4000).collect(), key=lambda r: r["part_no"])
    assert len(got) == parts
    assert got[0]["start"] == 0 and got[-1]["end"] == size


def py_rows(rows, limit=1000):
    total, chunks, cur = 0, [], []
    for row, n in rows:
        total += n
        if total >= limit:
            chunks.append(cur)
            cur = []
            total = n
        cur.append(row)
    if cur:
        chunks.append(cur)
    return ["\n".join(c) for c in chunks if c]


def _rows_df(spark, files):
    data = []
    for f, rows in files.items():
        for i, r in enumerate(rows):
            data.append((f, i, r))
    return spark.createDataFrame(data, "file long, row_no long, row string")


@pytest.mark.parametrize("partitions", [1, 3, 40, 200])
def test_row_packing_equals_python_however_files_are_split(spark, partitions):
    from tessera.functions.text import token_count

    rnd = random.Random(3)
    files = {f: ["h,e,a,d"] + [",".join(str(rnd.randint(0, 10 ** rnd.randint(1, 30))) for _ in range(rnd.randint(1, 30)))
                               for _ in range(rnd.randint(1, 300))] for f in range(6)}
    files[99] = ["x " * 1200, "a", "b"]  # first row over the limit
    files[100] = ["", "x " * 1200, "x"]  # a row without tokens is a row
    files[101] = [""]
    files[102] = ["x " * 999, "", "y", "z " * 1000, "", "x " * 3000, "x " * 3000]
    files[103] = ["w " * rnd.randint(0, 400) for _ in range(400)]
    df = _rows_df(spark, files)
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    got = {}
    for r in chunking.pack_table_rows(df, name, partitions=partitions).collect():
        got.setdefault(r["file"], {})[r["chunk_no"]] = r["chunk"]
    toks = {(r["file"], r["row_no"]): r["n"] for r in df.select("file", "row_no", token_count("row").alias("n")).collect()}
    for f, rows in files.items():
        exp = [f"f{f}\n\n" + body for body in py_rows([(r, toks[(f, i)]) for i, r in enumerate(rows)])]
        assert got[f] == dict(enumerate(exp)), f
    assert chunking.pack_table_rows(df.limit(0), name).collect() == []


def test_rows_are_shuffled_once(spark):
    """Blocks are read as they were written; one that a scan has split is an error."""
    import pyarrow as pa

    from tessera.operators import row_packing

    df = _rows_df(spark, {f: ["h"] + ["a b c " * 9] * 400 for f in range(5)})
    plan = chunking.pack_table_rows(df, lambda c: c.cast("string"), partitions=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
    rows = pa.record_batch({"file": [1], "block": [0], "place": [5], "row": ["x"], "n": [1], "open": [0], "chunk": [0]})
    with pytest.raises(RuntimeError, match="split"):
        next(row_packing._packed(10)(iter([rows])))


def test_rows_without_tokens_after_a_large_row(spark):
    files = {1: ["x " * 1200, "", "", "y"], 2: ["", "", "x " * 1000, "", "z " * 999, "", "q"]}
    got = {(r["file"], r["chunk_no"]): r["chunk"] for r in chunking.pack_table_rows(_rows_df(spark, files), lambda c: c.cast("string"), partitions=3).collect()}
    for f, rows in files.items():
        exp = [f"{f}\n\n" + body for body in py_rows([(r, len(r.split())) for r in rows])]
        assert [got[f, i] for i in range(len(exp))] == exp and len([k for k in got if k[0] == f]) == len(exp)
