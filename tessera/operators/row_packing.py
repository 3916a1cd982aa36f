"""Greedy packing of ordered rows per file (C2), for files of any size.

The rule is sequential: a row that brings the open chunk to ``limit`` tokens or
more closes it and opens the next.  But what a stretch of rows does to whatever
comes in is a small table: once the first row that closes a chunk is known, all
later ones follow, and that first row depends on the incoming tokens alone.

1. ``repartitionByRange(file, order)`` splits a large file over tasks ("blocks").
   A pass writes the rows of a block, in order, and one row per block with the
   table of its first file: for each row that could be the first to close (at most
   ``limit`` + 1), the tokens left open at the block's end and the chunks closed.
2. The tables of a file's blocks are chained in block order: what comes into each.
3. A second pass reads the blocks as they lie and packs the rows, so rows are
   shuffled once.  A block is one file of one row group, which a scan never splits.
   Chunks inside of a block are complete; the first and last of a block are put
   together by (file, chunk).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, work_dir

#: Bytes of a row group: more than a block has, so a block is one row group (a block that isn't is an error).
ROW_GROUP = 1 << 30


def outcome(n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, left, closed): for each row that could be the first to close a
    chunk, the tokens up to it, the open tokens at the end if it is, and the
    chunks that are closed from it on."""
    m, sums = len(n), np.cumsum(n)
    to = np.maximum(np.searchsorted(sums, limit + sums - n), np.arange(m) + 1).tolist()  # the next row that closes
    last, more = list(range(m)), [0] * m
    for i in range(m - 1, -1, -1):
        if to[i] < m:
            last[i], more[i] = last[to[i]], more[to[i]] + 1
    before = np.concatenate([[0], sums[:-1]])
    could = np.flatnonzero((before < limit) & ((n > 0) | (np.arange(m) == 0)))
    final = np.array(last)[could]
    return sums[could], sums[-1] - sums[final] + n[final], 1 + np.array(more)[could]


def _numbered(limit: int, schema: T.StructType):
    """Rows with block and place, and per block the rows ``first`` and ``last``:
    what its first file does to the tokens that come in, and what its last file
    leaves if it is another."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        block, place, file, first = TaskContext.get().partitionId(), 0, None, True
        sizes: list[np.ndarray] = []  # of the current file, in this block

        def close(kind: str):
            n = np.concatenate(sizes)
            sums, left, closed = outcome(n, limit)
            if kind == "last":  # its first row is the file's first row
                k = int(np.searchsorted(sums, limit))
                cut = k < len(sums)
                return {"left": [int(left[k] if cut else n.sum())], "closed": [int(closed[k] if cut else 0) - int(n[0] >= limit)]}
            return {"sums": sums.tolist(), "left": left.tolist(), "closed": closed.tolist(), "n": int(n.sum())}

        def extra(kind: str, name, x: dict):
            row = {f.name: [None] for f in schema.fields} | {"file": [name], "block": [block], "place": [-1], "kind": [kind]} | {k: [v] for k, v in x.items()}
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        arrow = None
        for rb in batches:
            if not rb.num_rows:
                continue
            if arrow is None:
                kinds = {"block": pa.int32(), "place": pa.int64(), "kind": pa.string(), "sums": pa.list_(pa.int64()), "left": pa.list_(pa.int64()), "closed": pa.list_(pa.int64())}
                arrow = pa.schema([(f.name, kinds.get(f.name) or rb.schema.field(f.name).type) for f in schema.fields])
            names = rb.column("file").to_pylist()
            n = rb.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(bounds, bounds[1:]):
                if sizes and names[a] != file:
                    if first:
                        yield extra("first", file, close("first"))
                    first, sizes = False, []
                file = names[a]
                sizes.append(n[a:b])
            empty = [pa.nulls(rb.num_rows, f.type) for f in arrow]
            known = {c: rb.column(c) for c in rb.schema.names} | {
                "block": pa.array([block] * rb.num_rows, pa.int32()), "place": pa.array(range(place, place + rb.num_rows), pa.int64())}
            yield pa.RecordBatch.from_arrays([known.get(f.name, e) for f, e in zip(arrow, empty)], schema=arrow)
            place += rb.num_rows
        if sizes:
            kind = "first" if first else "last"
            yield extra(kind, file, close(kind))

    return run


def _chained(limit: int):
    """``first`` and ``last`` rows by file and block, to (block, open, chunk):
    the tokens open and the chunk's number before the block's first row."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        file, state = None, None
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                if r["file"] != file:
                    file, state = r["file"], None
                if r["kind"] == "last":
                    state = r["left"][0], r["closed"][0]
                    continue
                # a file's first row never closes a chunk, so one that could doesn't count
                tokens, chunk = state or (0, -int(r["sums"][0] >= limit))
                out.append((r["block"], tokens, chunk))
                k = int(np.searchsorted(r["sums"], limit - tokens))
                state = (r["left"][k], chunk + r["closed"][k]) if k < len(r["sums"]) else (tokens + r["n"], chunk)
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["block", "open", "chunk"])

    return run


def _packed(limit: int):
    """Rows block by block, in order, with what comes into the block, to parts of
    chunks; ``edge``: another block may hold more of the chunk."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        kind = block = file = None
        tokens = chunk = 0
        held: list[str] = []
        edge, read = False, 0
        out: list[tuple] = []

        def part(last: bool):
            if held:
                out.append((file, chunk, block, edge or last, "\n".join(held)))
                held.clear()

        def batch():
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                              names=["file", "chunk_no", "block", "edge", "body"])

        for rb in batches:
            if not rb.num_rows:
                continue
            kind = rb.schema.field("file").type
            files, rows = rb.column("file").to_pylist(), rb.column("row").to_pylist()
            blocks, places, n, opened, numbers = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("block", "place", "n", "open", "chunk"))
            new = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or blocks[i] != blocks[i - 1]), len(files)]
            for a, b in zip(new, new[1:]):
                if blocks[a] != block:
                    part(True)
                    read = 0
                    block, file, tokens, chunk, edge = int(blocks[a]), files[a], int(opened[a]), int(numbers[a]), True
                elif files[a] != file:
                    part(False)
                    # a file's first row never closes a chunk, so one that could doesn't count
                    file, tokens, chunk, edge = files[a], 0, -int(n[a] >= limit), False
                if places[a] != read:
                    raise RuntimeError(f"block {block} was split: its row {read} is missing")
                read += b - a
                sums, at = np.cumsum(n[a:b]), a
                while at < b:
                    before = int(sums[at - a] - n[at])
                    close = max(at, a + int(np.searchsorted(sums, limit - tokens + before)))  # the next row that closes
                    if close > at:
                        held.extend(rows[at:close])
                        tokens += int(sums[close - 1 - a]) - before
                    at = close
                    if at < b:
                        part(False)
                        held.append(rows[at])
                        tokens, chunk, edge, at = int(n[at]), chunk + 1, False, at + 1
            yield batch()
        if held:
            part(True)
            yield batch()

    return run


def pack(rows: DataFrame, limit: int, partitions: int | None = None) -> DataFrame:
    """``rows(file, ord, row, n)`` to ``(file, chunk_no, body)``: rows joined by
    newlines, each chunk with at least one row; ``ord`` is unique within a file."""
    kind = rows.schema["file"].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("file", kind), T.StructField("row", T.StringType()), T.StructField("n", T.LongType()), T.StructField("block", T.IntegerType()),
                           T.StructField("place", T.LongType()), T.StructField("kind", T.StringType()), *(T.StructField(c, longs) for c in ("sums", "left", "closed"))])
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), "file", "ord").sortWithinPartitions("file", "ord")
    path = work_dir(rows.sparkSession, "pack-rows")
    ranged.select("file", "row", F.col("n").cast("long").alias("n")).mapInArrow(_numbered(limit, schema), schema) \
        .write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    blocks = rows.sparkSession.read.schema(schema).parquet(path)
    into = blocks.where("kind is not null").drop("row", "place").repartition("file").sortWithinPartitions("file", "block", "kind")
    into = materialize(into.mapInArrow(_chained(limit), "block int, open long, chunk long"), "pack-open")
    # one row per block; a broadcast join keeps the order of the rows
    full = blocks.where("kind is null").select("file", "row", "n", "block", "place").join(F.broadcast(into), "block")
    parts = materialize(full.mapInArrow(_packed(limit), T.StructType([
        T.StructField("file", kind), T.StructField("chunk_no", T.LongType()), T.StructField("block", T.IntegerType()),
        T.StructField("edge", T.BooleanType()), T.StructField("body", T.StringType())])), "pack-parts")
    joined = parts.where("edge").groupBy("file", "chunk_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "body"))), lambda x: x["body"]), "\n").alias("body"))
    return parts.where("not edge").select("file", "chunk_no", "body").unionByName(joined)
