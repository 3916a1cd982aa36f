"""Token ids in binary files: canonical length-limited Huffman codes.

1. Texts are tokenised where they are read, and their ids counted in the same
   pass.  The sums of the counts, at most one row per id of the vocabulary, reach
   the driver.  Package-merge gives code lengths of at most ``max_bits``; the lengths
   alone are the codebook.
2. The ids, not the texts, are brought into ascending ``doc_id`` order (range
   partitions, sorted within) and packed into blocks of whole documents.
3. Each block is coded by itself: its bits, the number of ids of each of its
   documents, and the bit offset of every ``STEP``-th id (the checkpoints).
4. Reading decodes all stretches between checkpoints of a block side by side,
   one table look-up per id.

The files are Parquet tables ``blocks`` and ``codebook`` in one folder, written
by Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batches, partitions, pick, strings
from tessera.llm.tokens import tokenizer
from tessera.session import work_dir

#: Ids between two checkpoints, and ids after which a block is closed (by whole documents).
STEP, BLOCK = 256, 1 << 19
#: Ids coded at a time.
PART = 1 << 14


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code length of each id (0: never occurs), none over ``max_bits``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, from_leaf = leaves, []
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        from_leaf.append(rank < len(leaves))
        level = both[rank]
    # the 2n - 2 cheapest of the last list; each package there stands for two of the list before
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for leaf in reversed(from_leaf):
        n = int(leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all ids, and the ids in code order (by length, then id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(lengths[order].max())
        space = np.uint64(1) << (top - lengths[order]).astype(np.uint64)  # share of each code of the 2^top patterns
        codes[order] = (np.cumsum(space) - space) >> (top - lengths[order]).astype(np.uint64)
    return codes, order


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, padded to bytes, and the checkpoints.  Ids go through
    in parts that stay in the processor's cache."""
    size = lengths[ids]
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    for low in range(0, len(ids), PART):
        part = slice(low, low + PART)
        at = ends[part] - size[part]
        code, word, room = codes[ids[part]], at >> 6, 64 - (at & 63) - size[part]
        fits = np.maximum(room, 0).astype(np.uint64)
        over = np.maximum(-room, 0).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] += np.add.reduceat((code >> over) << fits, first)
        cut = np.flatnonzero(room < 0)  # at most one code crosses the end of each word
        words[word[cut] + 1] += code[cut] << (np.uint64(64) - over[cut])
    return words.astype(">u8").tobytes()[: (total + 7) // 8], (ends - size)[::STEP]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        _, order = canonical(lengths)
        self.bits = int(lengths.max(initial=1))
        share = np.int64(1) << (self.bits - lengths[order]).astype(np.int64)
        #: by the next ``bits`` bits: the id, and the length of its code in the lowest five
        self.entry = np.ones(1 << self.bits, np.uint32)
        self.entry[:int(share.sum())] = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order], share)

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        b = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        lanes = len(checkpoints)
        out = np.zeros((min(STEP, n), lanes), np.uint32)
        at, free, mask = checkpoints.astype(np.uint32), np.uint32(32 - self.bits), np.uint32((1 << self.bits) - 1)
        for i in range(min(STEP, n)):
            if (lanes - 1) * STEP + i >= n > 0:  # the last stretch is shorter
                lanes -= 1
                at = at[:lanes]
            found = self.entry[window[at >> 3] >> (free - (at & 7)) & mask]
            out[i, :lanes] = found >> 5
            at = at + (found & 31)
        return out.T.reshape(-1)[:n]


def _packed(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers if all fit, else as 32-bit numbers, with the width in front."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(id, tie, ids, counts): the ids of each document, and per task one row with
    the counts of all its ids instead."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts, end = tokenizer(path), np.zeros(0, np.int64), np.array([end_id], np.uint32)
        schema = None
        for batch in it:
            schema = pa.schema([("id", batch.column(0).type), ("tie", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [np.concatenate([x, end]) for x in model.encode(strings(part.column(2)))]
                counts = _summed(counts, np.bincount(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_packed(x) for x in found], pa.binary()), pa.nulls(len(found), pa.binary())], schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_pydict({"id": [None], "tie": [None], "ids": [None], "counts": [counts.astype("<i8").tobytes()]}, schema=schema)

    # the hash lets a range end between rows that share an id or have none
    return docs.select("id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, f"id {kind}, tie long, ids binary, counts binary")


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b.astype(np.int64), a
    a[:len(b)] += b
    return a


def count_ids(tokenised: DataFrame) -> DataFrame:
    """(id, n) over all documents; a task sends one row per id at most."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in it:
            for part in batch.column(0):
                counts = _summed(counts, np.frombuffer(part.as_py(), "<i8"))
        used = np.flatnonzero(counts)
        yield batches(schema, {"id": used, "n": counts[used]})

    return tokenised.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(df: DataFrame, path: str, tokenizer_path: str, end_id: int, max_bits: int = 20,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text (a null text is empty: the end id alone) to
    ``path``.  Null ids come first, repeated ids in any order among themselves;
    an empty table gives empty files."""
    spark = df.sparkSession
    plain = work_dir(spark, "token-ids")
    _tokenised(pick(df, id=id_col, text=text_col), tokenizer_path, end_id).write.option("compression", "zstd").parquet(plain)
    tokenised = spark.read.parquet(plain)
    book = {r["id"]: r["n"] for r in count_ids(tokenised).collect()}  # bounded by the vocabulary
    counts = np.zeros(max(book, default=0) + 1, np.int64)
    counts[list(book)] = list(book.values())
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int") \
        .coalesce(1).write.parquet(f"{path}/codebook")
    codes = canonical(lengths)[0]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held, key = TaskContext.get().partitionId(), 0, 0, 0, None
        keys: list = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start, held
            bits, marks = encode(np.concatenate(parts), codes, lengths)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "start": pa.array([start], pa.int64()),
                "ids_of": pa.array([keys], pa.list_(key)), "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
                "checkpoints": pa.array([marks.tolist()], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary())})
            block, start, held = block + 1, start + held, 0
            keys.clear(), parts.clear()
            return row

        for batch in it:
            key = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                parts.append(_unpacked(ids.as_py()))
                held += len(parts[-1])
                if held >= BLOCK:
                    yield close()
        if keys:
            yield close()

    kind = tokenised.schema["id"].dataType.simpleString()
    ordered = tokenised.where("counts is null").repartitionByRange(partitions(df), "id", "tie").sortWithinPartitions("id", "tie")
    ordered.select("id", "ids").mapInArrow(run, f"part int, block int, start long, ids_of array<{kind}>, sizes array<int>, checkpoints array<long>, bits binary") \
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _read(spark: SparkSession, path: str, name: str, kind: str, of) -> DataFrame:
    """(id, start, n_tokens, ``name``): every document of the files at ``path``
    with ``of`` its decoded ids (little-endian 32-bit integers)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}  # bounded by the vocabulary
    lengths = np.zeros(max(book, default=0) + 1, np.uint8)
    lengths[list(book)] = list(book.values())
    # one number per range partition
    per_part = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, total = {}, 0
    for r in sorted(per_part.collect()):
        before[r["part"]], total = total, total + r["n"]
    type_ = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in it:
            decoder = decoder or Decoder(lengths)
            for i in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[i].values, np.int64)
                ends = np.cumsum(sizes)
                ids = decoder.decode(batch.column("bits")[i].as_py(), np.array(batch.column("checkpoints")[i].values, np.int64), int(ends[-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                first = before[batch.column("part")[i].as_py()] + batch.column("start")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids_of")[i].values, pa.array(first + ends - sizes), pa.array(sizes),
                     pa.array([of(raw[4 * (e - s):4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], type_)],
                    names=["id", "start", "n_tokens", name])

    key = blocks.schema["ids_of"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"id {key}, start long, n_tokens long, {name} {kind}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): every document of the files at ``path`` with
    its decoded ids as little-endian 32-bit integers; ``start`` counts the ids
    of all documents before it."""
    return _read(spark, path, "ids", "binary", bytes)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of the files at
    ``path``: :func:`read_ids` with the checksum of the ids in their place."""
    return _read(spark, path, "ids_crc32", "long", zlib.crc32).withColumnRenamed("id", "doc_id")
