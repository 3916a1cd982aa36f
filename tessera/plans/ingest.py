"""K1 from a folder: scan, dispatch, decode, chunk (text by words, tables by
rows), union the branches (S1), embed and store.  Undecodable files form the
rejects table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from itertools import groupby
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, embed, store
from tessera.session import file_system, materialize, work_dir
from tessera.sources import files as FS

#: Folders that a document table's files are spread over.
FOLDERS = 256


def folder_chunks(spark: SparkSession, path: str, decoders: dict[str, Callable[[bytes], str]] | None = None,
                  recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns ``(chunks(name, kind, chunk_no, chunk), rejects(name, kind, error))``."""
    return chunk_files(FS.scan_folder(spark, path, recursive), decoders)


def decoded_files(scanned: DataFrame, decoders: dict | None = None) -> DataFrame:
    """``(path, name, kind, text, error)``: every file read once and decoded once; the
    text is null where ``error`` says why.  Text files and CSV tables are UTF-8; all
    others go through the decoder of their extension."""
    utf8 = (F.col("kind") == "text") | (F.col("ext") == "csv")
    text, ok = F.col("content").cast("string"), F.is_valid_utf8(F.col("content").cast("string"))
    with FS.small_files(scanned.sparkSession):
        read = materialize(scanned.select("path", "name", "ext", "kind", utf8.alias("utf8"), F.when(utf8 & ok, text).alias("text"),
                                          F.when(~utf8, F.col("content")).alias("content")), "files-read")
    plain = read.where("utf8").select("path", "name", "kind", "text", F.when(F.col("text").isNull(), "invalid UTF-8").alias("error"))
    other = FS.decode_with(read.where("not utf8"), decoders or {})
    other = materialize(other.select("path", "name", "kind", F.when(F.col("ok"), F.col("text")).alias("text"), F.when(~F.col("ok"), F.col("error")).alias("error")), "files-decoded")
    return plain.unionByName(other)


def chunk_files(scanned: DataFrame, decoders: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and rejects of scanned files.  Decoded tables are packed by rows like CSV."""
    return chunk_texts(decoded_files(scanned, decoders))


def chunk_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = files.where("error is null")
    words = chunking.word_chunks(good.where(F.col("kind") != "table"), "text", keep=["name", "kind"])
    rows = FS.text_rows(good.where(F.col("kind") == "table")).select(F.col("name").alias("file"), "row_no", "row")
    tables = chunking.pack_table_rows(rows, lambda c: c).select(F.col("file").alias("name"), F.lit("table").alias("kind"), "chunk_no", "chunk")
    chunks = words.select("name", "kind", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk").unionByName(tables)
    return chunks, files.where("error is not null").select("name", "kind", "error")


def ingest_folder(spark: SparkSession, path: str, root: str, namespace: str = "homework",
                  decoders: dict[str, Callable[[bytes], str]] | None = None, recursive: bool = False,
                  dims: int = embed.DEFAULT_DIMS) -> DataFrame:
    """K1 end to end: the folder's chunks with vectors, merged into the store at
    ``root`` under the files' names; the rejects.  A decoded file replaces its
    earlier chunks even if it has none now; a rejected one keeps them."""
    files = decoded_files(FS.scan_folder(spark, path, recursive), decoders)
    chunks, rejects = chunk_texts(files)
    sources = files.where("error is null").select(F.lit(namespace).alias("namespace"), F.col("name").alias("source_id"))
    rows = chunks.select(F.lit(namespace).alias("namespace"), F.col("name").alias("source_id"), "chunk_no", "kind", F.col("chunk").alias("context"))
    store.upsert(spark, root, embed.with_hashed_vector(rows, "context", dims), sources=sources)
    return rejects


def file_of_name(name: str | None) -> str:
    """``<folder>/<file>`` for a name: the file is the name with all but letters, digits
    and ``_.-~`` as percent escapes (and never hidden), the folder one of ``FOLDERS`` by
    its hash.  :func:`tessera.sources.files.name_of_path` gives the name back."""
    name = name or "__HIVE_DEFAULT_PARTITION__"  # what a partitioned writer calls it
    file = quote(name, safe="")
    if file[0] in "._":
        file = f"%{ord(file[0]):02X}{file[1:]}"
    return f"part-{zlib.crc32(name.encode()) % FOLDERS:03d}/{file}"


def _file_writer(path: str):
    """Arrow batches ``(name, text)``, ordered by name, to files; yields how many."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(path)
        made, n = set(), 0
        rows = ((name, text) for rb in batches for name, text in zip(*(c.to_pylist() for c in rb.columns)))
        for name, same in groupby(rows, key=lambda r: r[0]):
            folder, file = file_of_name(name).split("/")
            if folder not in made:
                fs.create_dir(f"{base}/{folder}")
                made.add(folder)
            # under a hidden name of its own first, so that another attempt of the task never leaves half a file
            draft = f"{base}/{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                for _, text in same:
                    out.write(((text or "") + "\n").encode())
            fs.move(draft, f"{base}/{folder}/{file}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return run


def write_documents_as_files(docs: DataFrame, name_col: str = "f", text_col: str = "text") -> str:
    """Lay a document table out as a folder of files (one file per name, a line end
    behind each text) in the shared scratch folder; returns the folder.

    Every file is written by exactly one task, and the tasks write in parallel: a
    partitioned writer makes a folder per name, and its commit moves them one by one
    on the driver.  The files lie in ``FOLDERS`` folders, so that Spark's listing is
    spread over tasks too."""
    path = work_dir(docs.sparkSession, "files")
    rows = docs.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    rows = rows.select(F.when(F.col("name") != "", F.col("name")).alias("name"), "text")
    rows.repartition("name").sortWithinPartitions("name", "text").mapInArrow(_file_writer(path), "n long").agg(F.sum("n")).first()
    file_system(docs.sparkSession, path)[0].mkdirs(file_system(docs.sparkSession, path)[1])  # there without rows, too
    return path
