"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits, each set if it is set in over half of the text's shingle
hashes.  Two distinct fingerprints at ``BITS`` = 3 or fewer differing bits agree
in one of their two 32-bit segments but for one bit, so each segment's Hamming
ball of radius 1 is enumerated (a 0 turned into a 1 is enough: the other partner
holds the 1), the table of segments gives the matches, and complete distances
are verified.

Rows with equal fingerprints are one node.  A table entry's matches are linked
by a spanning forest, never as all pairs; an entry with many fingerprints is
dealt as pairs of blocks.  Components come from large-star / small-star rounds,
each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, pick, with_row_ids
from tessera.session import materialize

SHINGLE, BITS, SEED = 3, 3, 42
#: Fingerprints that one task compares with one another at a time.
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z only; white space is space and U+0009..U+000D
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))),
                         np.uint64, len(words) - n + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 15):
        part = hashes[low:low + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with a long ``fp`` (the bits as a signed number) in the text's place."""
    keep = [c for c in df.columns if c != text_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t, shingle) for t in byte_texts(b.column(b.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*keep, "fp"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*[df[c] for c in keep], df[text_col]).mapInArrow(run, ", ".join([*kinds, "fp long"]))


def _forest(fps: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is joined by pairs with a table row at ``bits`` or
    fewer differing bits: at most one link per fingerprint."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    near &= table[:, None] | table[None, :]
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(1, initial=len(fps))
        new = np.minimum(label, new)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _links(bits: int):
    """Scans rows sorted by key: (k1, k2, fp, entry) to links (a, b)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def linked(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            size = np.diff(starts)
            has = np.add.reduceat(cols[3].astype(np.int64), starts[:-1]) if len(size) else size
            for i in np.flatnonzero((size > 1) & (has > 0)):
                s = slice(starts[i], starts[i + 1])
                x, y = _forest(cols[2][s].view(np.uint64), cols[3][s], bits)
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in it:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            last = int(new[-1]) if len(new) else 0  # the last key may go on in the next batch
            rest = [c[last:] for c in cols]
            if last:
                yield linked([c[:last] for c in cols], np.concatenate([[0], new]))
        if rest is not None:
            yield linked(rest, np.array([0, len(rest[0])]))

    return run


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp``: linked at ``bits`` (1 to 3)
    or fewer differing bits, directly or through others of the same table entry."""
    if not 1 <= bits <= 3:
        raise ValueError("two segments with balls of radius 1 find 1 to 3 differing bits")
    fp = F.col("fp")
    half = [fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32)]
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    zeros = lambda seg: F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: half[seg].bitwiseAND(bit(i)) == 0)
    row = lambda seg, key, entry: F.struct(F.lit(seg).alias("seg"), key.alias("key"), F.lit(entry).alias("entry"))
    keys = lambda seg: F.concat(F.array(row(seg, half[seg], True)),
                                F.transform(zeros(seg), lambda i: row(seg, half[seg].bitwiseOR(bit(i)), False)))
    rows = fps.select("fp", F.explode(F.concat(keys(0), keys(1))).alias("x")).select(
        (F.col("x.key") * 2 + F.col("x.seg")).alias("k1"), "fp", F.col("x.entry").alias("entry"))
    big = materialize(rows.groupBy("k1").agg(F.count("*").alias("n"), F.max("entry").alias("has")).where(f"has and n > {BLOCK}").drop("has"), "simhash-big")
    usual = rows.join(big, "k1", "left_anti").select("k1", F.lit(0).cast("long").alias("k2"), "fp", "entry")
    found = usual.repartition("k1").sortWithinPartitions("k1").mapInArrow(_links(bits), "a long, b long")
    if big.limit(1).count():
        # blocks of about BLOCK / 2 by hash; a pair of blocks (i <= j) is a key of its own
        of = rows.join(big, "k1").withColumn("blocks", F.ceil(F.col("n") / (BLOCK // 2)).cast("int"))
        of = of.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "k1", (F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")).alias("k2"), "fp", "entry")
        found = found.union(dealt.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_links(bits), "a long, b long"))
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots themselves:
    root is the smallest node (as a signed number) of the node's component."""
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        # large star: each node hands its larger neighbours to its smallest
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = materialize(edges, "links")
        # small star: each node hands its smaller neighbours, and itself, to the smallest
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(low, "a").select("a", "b", "m")
        edges = edges.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")) \
            .select("e.a", "e.b").where("a != b").distinct()
        edges = materialize(edges, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def with_components(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` (which has ``fp`` and ``doc_id``) with ``component_id``."""
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named.withColumnRenamed("fp", "node"), "simhash-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(named.join(least, "root").select(F.col("node").alias("fp"), "component_id", "root"), "simhash-components")
    return docs.join(of, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row of ``df``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    A null text is empty: fingerprint zero, linked like any other.  Null ids
    name no component (it is null if a component has no other); repeated rows
    stay; an empty table gives no rows; other columns aren't read."""
    docs = materialize(fingerprints(pick(df, doc_id=id_col, text=text_col), "text", shingle), "fingerprints")
    return with_components(docs, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``df``, one of each component: the smallest id (null last);
    among repeated rows with that id, one."""
    rows = with_row_ids(df.select(F.struct(*[df[c] for c in df.columns]).alias("row")), "simhash-rows")
    docs = rows.select("rid", F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].alias("_text"))
    docs = materialize(fingerprints(docs, "_text", shingle), "fingerprints")
    best = with_components(docs, bits).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("x"))
    return rows.join(best.select(F.col("x.rid").alias("rid")), "rid", "left_semi").select("row.*")
