"""Folders of files (A1-A6): scan, dispatch by extension, decode, table rows.

A file is one row of the ``binaryFile`` source (its bytes in ``content``);
files are spread over tasks, and decoding runs where the bytes are.  Codecs
for pdf/docx/xlsx/images are not shipped: ``decode_with`` is the hook a user
fills with a ``bytes -> str`` function per extension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import file_extension, file_kind
from tessera.session import file_system

#: Bytes that opening a file is worth in a scan of a folder.
OPEN_COST = 64 * 1024
#: Bytes and files that a task which reads files hands on at once.
BATCH_BYTES, BATCH_FILES = 4 << 20, 2000


def name_of_path(path_col) -> object:
    """File name: the last path segment, or the value of a ``f=<name>``
    partition directory when files were written partitioned by name."""
    part = F.try_url_decode(F.regexp_extract(path_col, r"/f=([^/]+)/[^/]*$", 1))
    base = F.try_url_decode(F.regexp_extract(path_col, r"([^/]*)$", 1))
    return F.when(F.coalesce(part, F.lit("")) != "", part).otherwise(base)


def scan_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """A1 + A2: ``(path, name, ext, kind, length, content)``.

    Direct children only unless ``recursive``; Spark skips names starting with
    ``_`` or ``.`` (D7).  ``kind`` is the decoder family (A2/B12).

    With ``recursive`` the driver lists only the folder itself; the tasks list and read
    what lies in its folders (of file systems that ``pyarrow.fs`` knows; for others, Spark's
    reader holds the status of every file on the driver).
    """
    listed = _listed_by_tasks(spark, path) if recursive else None
    if listed is not None:
        return with_kind(listed)
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path)
    return with_kind(df)


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    out = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _listed_by_tasks(spark: SparkSession, path: str) -> DataFrame | None:
    """``(path, length, content)`` of all files below the folder; None if it is none or
    ``pyarrow.fs`` doesn't know its file system."""
    from pyarrow import fs as pafs

    fs, root = file_system(spark, path)
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        return None
    whole = fs.getFileStatus(root).getPath().toString()
    try:
        known = pafs.FileSystem.from_uri(path)
        if known[0].get_file_info(known[1]).type != pafs.FileType.Directory:
            return None
    except (ValueError, OSError, NotImplementedError):
        return None
    names = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(root)) if not _hidden(n))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), tasks)))
    return top.mapInArrow(_file_reader(path, whole), "path string, length long, content binary")


def _file_reader(path: str, whole: str):
    """Names in the folder ``path`` to the files at or below them; ``whole``: what their paths begin with."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(path)
        base = base.rstrip("/")
        held, size = [], 0

        def batch():
            nonlocal size
            size = 0
            out = pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.string()), pa.array([len(x) for _, x in held], pa.int64()),
                                              pa.array([x for _, x in held], pa.binary())], names=["path", "length", "content"])
            held.clear()
            return out

        def files(at):
            """The files at or below a place, folder by folder."""
            info = fs.get_file_info(at)
            if info.type == pafs.FileType.File:
                yield info.path
            elif info.type == pafs.FileType.Directory:
                for below in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at))):
                    if not _hidden(below.rsplit("/", 1)[-1]):
                        yield from files(below)

        for rb in batches:
            for name in rb.column(0).to_pylist():
                for file in files(f"{base}/{name}"):
                    with fs.open_input_stream(file, compression=None) as f:
                        content = f.read()
                    if not content:  # no row for an empty file, as with Spark's reader
                        continue
                    held.append((whole.rstrip("/") + file[len(base):], content))
                    size += len(content)
                    if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
                        yield batch()
        if held:
            yield batch()

    return run


@contextmanager
def small_files(spark: SparkSession):
    """While a folder is read: a file counts for its bytes and ``OPEN_COST``, not for
    4 MB more, by which a task of some megabytes has 32 files and a folder of many
    small ones as many tasks (and as many files of their rows)."""
    name = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def with_kind(df: DataFrame) -> DataFrame:
    name = name_of_path(F.col("path"))
    return df.select("path", name.alias("name"), "length", "content").select(
        "path", "name", file_extension(F.col("name")).alias("ext"), file_kind(F.col("name")).alias("kind"),
        "length", "content",
    )


def decode_utf8(files: DataFrame) -> DataFrame:
    """A3: strict UTF-8 text; undecodable bytes give ``''`` and ``ok = false``
    (the row also belongs in the rejects table)."""
    s = F.col("content").cast("string")
    ok = F.is_valid_utf8(s)
    return files.select(
        "path", "name", "ext", "kind", F.when(ok, s).otherwise(F.lit("")).alias("text"), ok.alias("ok")
    )


def decode_with(files: DataFrame, decoders: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """A4 hook: ``decoders[ext](bytes) -> str`` in Arrow batches.

    A failing or missing decoder gives ``''`` with the error in ``error``
    (``ok = false``); one bad file never stops the others (D10).
    """
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("ext", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, oks, errs = [], [], []
            for ext, raw in zip(pdf["ext"], pdf["content"]):
                fn = decoders.get(ext)
                try:
                    if fn is None:
                        raise LookupError(f"no decoder for {ext}")
                    texts.append(fn(bytes(raw)) or "")
                    oks.append(True)
                    errs.append(None)
                except Exception as ex:  # noqa: BLE001 - the file is rejected, not the job
                    texts.append("")
                    oks.append(False)
                    errs.append(f"{type(ex).__name__}: {ex}")
            yield pd.DataFrame({
                "path": pdf["path"], "name": pdf["name"], "ext": pdf["ext"], "kind": pdf["kind"],
                "text": texts, "ok": oks, "error": errs,
            })

    return files.select("path", "name", "ext", "kind", "content").mapInPandas(run, schema)


def text_rows(texts: DataFrame) -> DataFrame:
    """The rows of table files given as ``(path, name, text)``, as written:
    ``(path, name, row_no, row)``, the header at row 0.  Blank lines are no rows;
    values are kept as text (no type inference, D4); a line break inside a quoted
    field splits the row, as in the reference; a byte order mark is dropped."""
    lines = F.filter(F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n"), lambda r: F.btrim(r, F.lit(" \t")) != "")
    return texts.select("path", "name", F.posexplode(lines).alias("row_no", "row")).withColumn("row_no", F.col("row_no").cast("bigint"))


def csv_rows(files: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """A5 + A6: the rows of CSV files (:func:`text_rows`).  ``charset`` is given
    by the user (no detection).  A file that isn't valid UTF-8 has no rows here:
    :func:`decode_utf8` names it, it belongs in the rejects."""
    if charset.upper().replace("-", "") == "UTF8":
        return text_rows(decode_utf8(files).where("ok"))
    return text_rows(files.withColumn("text", F.decode(F.col("content"), charset)))


def csv_table(spark: SparkSession, path: str, encoding: str = "UTF-8", infer: bool = False) -> DataFrame:
    """A5 as a table: ``spark.read.csv`` with header, strings unless ``infer``."""
    return (
        spark.read.option("header", True).option("encoding", encoding).option("inferSchema", infer)
        .option("multiLine", True).csv(path)
    )


def csv_render(df: DataFrame) -> DataFrame:
    """A6 render: one CSV line per row with quotes doubled inside quoted
    fields, as pandas writes them (``q"t`` -> ``"q""t"``)."""
    return df.select(F.to_csv(F.struct(*df.columns), {"escape": '"', "quoteAll": "false"}).alias("row"))
