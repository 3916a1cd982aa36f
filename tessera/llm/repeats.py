"""Repeated passages by column-wise construction over many strings.

Removes every byte that lies in a string of ``length`` bytes which starts at
another place too, in any document.

1. Anchors.  A place is an anchor if the hash of the ``gram`` bytes that start
   there is the least of some window of ``length`` bytes.  Equal windows have
   equal anchors at equal places, so windows need comparing only between the
   strings round equal anchors: up to ``length - gram`` bytes before the anchor
   and ``length`` from its start.  Strings that are equal as a whole are counted
   and carried once; an anchor that occurs once is out.
2. Construction.  The strings of a task stand with their anchors in one column.
   From the last column to the first, each round inserts one symbol per string:
   the sorted order of all suffixes that start in the column (whose preceding
   symbols are the collection's Burrows-Wheeler transform there) follows from
   the order one column on by a stable sort on the new symbol, and the common
   prefixes of neighbours follow from range minima.  Columns are read one after
   another from a sequential file; a task holds a few numbers per string.
   A window is repeated if its suffix shares ``length`` bytes with a neighbour.
   Equal windows start in the same column, so orders of different columns need
   not be merged, and the rounds don't grow with the longest document.
3. Anchors with more than ``limit`` different strings are dealt again by longer
   cores: windows that start in the same stretch of ``width`` places share
   ``length - width + 1`` bytes, which is their key.  Cores that still have too
   many are dealt by narrower stretches, a few for each string.  At width 1 the
   core is the window itself and no construction is left to do.
4. Documents collect the window starts of their anchors and lose those bytes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches, partitions, ranges
from tessera.session import materialize

LENGTH, GRAM = 400, 128
#: Different strings round one anchor that a task takes together; stretches into which more are dealt.
LIMIT, WIDTHS = 4096, (91, 31, 11, 4, 1)
#: Strings of a construction, and places hashed at a time.
BATCH, SPAN = 16384, 1 << 16

_BYTE = np.random.default_rng(400).integers(1, 1 << 32, 256, dtype=np.uint32)
_CUTS = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("u1", pa.int64()), ("u2", pa.int64()), ("pos", pa.int32())])
_STRINGS = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("left", pa.int32()), ("whole", pa.bool_()), ("string", pa.binary())])
_FOUND = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the ``gram`` bytes at each place: sums of two halves,
    each hashed the same way."""
    parts, h, size, at = [], _BYTE[data], 1, 0
    n = len(data) - gram + 1
    while True:
        if gram & size:
            parts.append(h[at:at + n])
            at += size
        size *= 2
        if size > gram:
            break
        h = h[:-(size // 2)] * np.uint32(2654435761) + h[size // 2:]
        h ^= h >> np.uint32(15)
    out = parts[0].copy()
    for p in parts[1:]:
        out = out * np.uint32(2246822519) + p
    return out


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:n], x[width - size:width - size + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Places whose gram has the least hash of a window of ``length`` bytes."""
    if len(text) < length:
        return np.zeros(0, np.int64)
    data, width = np.frombuffer(text, np.uint8), length - gram + 1
    total, found = len(text) - gram + 1, []  # places of grams
    for low in range(0, total, SPAN):
        a, b = max(0, low - width + 1), min(total, low + SPAN + width - 1)
        h = _grams(data[a:b + gram - 1], gram)
        least = _extreme(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint32)
        opened = _extreme(np.concatenate([pad, least, pad]), width, np.maximum)
        at = np.flatnonzero(opened == h) + a
        found.append(at[(at >= low) & (at < low + SPAN)])
    return np.concatenate(found)


def _cut(text: bytes, pos: int, length: int, gram: int) -> tuple[int, int]:
    return max(0, pos - length + gram), min(len(text), pos + length)


def _cuts(length: int, gram: int):
    """(u1, u2, text) to one row per anchor: its key, the hash of its string, its place."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, shs, rows, places = [], [], [], []
            for i, value in enumerate(b.column(2)):
                text = value.as_py()
                for pos in anchors(text, length, gram).tolist():
                    lo, hi = _cut(text, pos, length, gram)
                    keys.append(_signed(xxhash.xxh3_64_intdigest(text[pos:pos + gram])))
                    shs.append(_signed(xxhash.xxh3_64_intdigest(text[lo:hi], pos - lo)))
                    rows.append(i)
                    places.append(pos)
                if len(keys) >= BATCH or i + 1 == b.num_rows:
                    of = pa.array(rows, pa.int64())
                    yield batches(_CUTS, {"key": keys, "sh": shs, "u1": b.column(0).take(of), "u2": b.column(1).take(of), "pos": places})
                    keys, shs, rows, places = [], [], [], []

    return run


def _stretches(length: int, width: int, span: int):
    """(u1, u2, text, left, ...) to one row per stretch of window starts; ``span``:
    window starts round an anchor."""
    gram = length - width + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[], [], [], [], []]
            for u1, u2, text, left in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for g in range(-(-span // width)):
                    pos = left - g * width
                    if pos < 0 or pos + gram > len(text):
                        continue
                    lo, hi = _cut(text, pos, length, gram)
                    seed = (u1 ^ g) & (1 << 64) - 1
                    for c, x in zip(out, (_signed(xxhash.xxh3_64_intdigest(text[pos:pos + gram], seed)),
                                          _signed(xxhash.xxh3_64_intdigest(text[lo:hi], pos - lo)), u1, u2, pos), strict=True):
                        c.append(x)
            yield batches(_CUTS, dict(zip(_CUTS.names, out, strict=True)))

    return run


def _strings(length: int, gram: int):
    """(text, array of (key, sh, whole, pos)) to one row per string; ``whole``:
    all its windows are known to be repeated."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                text, wanted = text.as_py(), wanted.as_py()
                for low in range(0, len(wanted), 4096):
                    part = wanted[low:low + 4096]
                    ends = [_cut(text, w["pos"], length, gram) for w in part]
                    yield batches(_STRINGS, {"key": [w["key"] for w in part], "sh": [w["sh"] for w in part], "whole": [w["whole"] for w in part],
                                             "left": [w["pos"] - lo for w, (lo, _) in zip(part, ends, strict=True)],
                                             "string": [text[lo:hi] for lo, hi in ends]})

    return run


def construct(keys: np.ndarray, lefts: np.ndarray, strings: list[bytes], length: int, gram: int) -> np.ndarray:
    """[string, column]: is the window that starts there one that another string
    of its key has in the same column?  Columns: ``length - gram`` places before
    the anchor, and the anchor's own.  ``keys``: numbers from 0.  Strings of
    different keys may be of one place, so equal windows of theirs tell nothing."""
    m, before = len(strings), length - gram
    sizes = np.fromiter(map(len, strings), np.int64, m)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    columns = np.zeros((before + length, m), np.uint16)  # 0: no symbol, outside of the document
    columns[np.repeat(before - lefts, sizes) + ranges(sizes), np.repeat(np.arange(m), sizes)] = flat.astype(np.uint16) + 1
    out = np.zeros((m, before + 1), bool)
    with tempfile.TemporaryFile() as file:  # last column first, as the rounds read them
        for c in range(before + length - 1, -1, -1):
            file.write(columns[c].tobytes())
        del columns, flat
        file.seek(0)
        order, prefix = np.arange(m), np.zeros(m, np.int32)  # prefix[i]: shared by the i-th suffix and the one before
        for c in range(before + length - 1, -1, -1):
            transform = np.frombuffer(file.read(2 * m), np.uint16)[order]
            to = np.argsort(transform, kind="stable")
            symbol = transform[to]
            new = np.zeros(m, np.int32)
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
            low, high = to[same - 1] + 1, to[same]
            least = prefix[high]
            wide = np.flatnonzero(low < high)
            if len(wide):
                ends = np.stack([low[wide], high[wide]], 1).reshape(-1)  # the minimum of low..high-1 and of high itself
                least[wide] = np.minimum(least[wide], np.minimum.reduceat(prefix, ends)[::2])
            new[same] = np.minimum(least + 1, length)
            order, prefix = order[to], new
            if c <= before:
                full = np.flatnonzero(prefix == length)
                one, other = order[full - 1], order[full]
                if (keys[one] != keys[other]).any():  # a run of equal windows holds several keys
                    at = np.union1d(full - 1, full)
                    pair = np.cumsum(prefix < length)[at] * m + keys[order[at]]  # run and key
                    by = np.argsort(pair, kind="stable")
                    same = np.flatnonzero(pair[by[1:]] == pair[by[:-1]])
                    one, other = order[at[by[same]]], order[at[by[same + 1]]]
                out[one, c] = True
                out[other, c] = True
    return out


def _found(length: int, gram: int):
    """Strings sorted by key and sh to the repeated window starts of each that isn't ``whole``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def build(rows: list[tuple]) -> pa.RecordBatch:
            lefts = np.array([r[2] for r in rows], np.int64)
            keys = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
            hit = construct(keys, lefts, [r[4] for r in rows], length, gram)
            hit[[r[3] for r in rows]] = False
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            who, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            some, n = np.unique(who, return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x - (length - gram), pa.int32())) for x in (first, last)]
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), *lists], schema=_FOUND)

        for b in it:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # from a row that occurs repeatedly
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield build(held)
                    held = []
                held.append(row)
        if held:
            yield build(held)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _repeated(texts: DataFrame, cuts: DataFrame, length: int, gram: int, widths: tuple[int, ...], limit: int) -> DataFrame:
    """(u1, u2, marks): the repeated windows of each text as an array of (pos,
    starts, ends), runs of window starts relative to ``pos``; null starts: all
    windows round ``pos``.  ``texts``: (u1, u2, text)."""
    cuts = materialize(cuts, "repeat-cuts")
    by_string = cuts.groupBy("key", "sh").agg(F.count("*").alias("n"), F.min(F.struct("u1", "u2", "pos")).alias("rep"))
    keys = by_string.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("strings")).where("total > 1").drop("total")
    shared = materialize(by_string.join(keys, "key"), "repeat-shared")
    marked = shared.where("n > 1").select("key", "sh", *[F.lit(None).cast("array<int>").alias(c) for c in ("starts", "ends")])
    if gram < length:
        several = shared.where("strings > 1")
        wanted = several.groupBy("rep.u1", "rep.u2").agg(F.collect_list(F.struct("key", "sh", "rep.pos", (F.col("n") > 1).alias("whole"))).alias("wanted"))
        strings = texts.join(wanted, ["u1", "u2"]).select("text", "wanted").mapInArrow(_strings(length, gram), _ddl(_STRINGS))
        many = keys.where(F.col("strings") > limit)
        if hot := shared.where(F.col("strings") > limit).limit(1).count():
            strings = materialize(strings, "repeat-strings")
        usual = strings.join(many, "key", "left_anti") if hot else strings
        found = usual.repartition(partitions(cuts), "key").sortWithinPartitions("key", "sh").mapInArrow(_found(length, gram), _ddl(_FOUND))
        if hot:
            inner = materialize(strings.join(many, "key", "left_semi").select(F.col("key").alias("u1"), F.col("sh").alias("u2"), F.col("string").alias("text"), "left", "whole"), "repeat-hot")
            width = next(w for w in widths if length - w + 1 > gram)
            again = _repeated(inner.select("u1", "u2", "text"), inner.mapInArrow(_stretches(length, width, length - gram + 1), _ddl(_CUTS)),
                              length, length - width + 1, widths, limit)
            # window starts in the string are those round the anchor
            placed = inner.where("not whole").select("u1", "u2", "left", F.length("text").alias("size")).dropDuplicates(["u1", "u2"]).join(again, ["u1", "u2"])
            found = found.unionByName(placed.mapInArrow(_placed(length, length - width + 1), _ddl(_FOUND)))
        marked = marked.unionByName(found)
    marks = cuts.join(marked, ["key", "sh"]).select("u1", "u2", F.struct("pos", "starts", "ends").alias("mark"))
    return marks.groupBy("u1", "u2").agg(F.collect_set("mark").alias("marks"))


def windows(marks: list[dict], size: int, length: int, gram: int) -> np.ndarray:
    """Rows (first, last) of repeated window starts in a text of ``size`` bytes,
    joined where they overlap or touch, ascending."""
    runs = []
    for m in marks:
        if m["starts"] is None:
            runs.append((max(0, m["pos"] - length + gram), min(size - length, m["pos"])))
        else:
            runs += [(m["pos"] + a, m["pos"] + b) for a, b in zip(m["starts"], m["ends"], strict=True)]
    runs = [r for r in runs if r[0] <= r[1]]
    return _joined(np.array(runs, np.int64).reshape(-1, 2))


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs (first, last) with those that overlap or touch joined."""
    if not len(runs):
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > ends[:-1] + 1])
    return np.stack([runs[new, 0], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(runs) - 1]])]], 1)


def _placed(length: int, gram: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, shs, left, size, marks = (b.column(i).to_pylist() for i in range(5))
            runs = [windows(m, n, length, gram) - at for m, n, at in zip(marks, size, left, strict=True)]
            yield batches(_FOUND, {"key": keys, "sh": shs, "starts": [r[:, 0].tolist() for r in runs], "ends": [r[:, 1].tolist() for r in runs]})

    return run


def _identity(key: Column, text: Column) -> list[Column]:
    """128 bits that name a row; equal rows share them (and so all that is found for them)."""
    parts = [key.isNull(), key.cast("string"), text]
    return [F.xxhash64(F.lit(i), *parts).alias(f"u{i}") for i in (1, 2)]


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
          widths: tuple[int, ...] = WIDTHS, limit: int = LIMIT) -> DataFrame:
    """(row, text, marks) per row of ``df``: all its columns as one struct, its
    text as bytes, and its repeated windows (null: none) for :func:`removed`.

    A null text is empty.  Repeated rows are documents of their own, so all their
    windows are repeated; null ids are allowed; an empty table gives no rows.
    Texts shorter than ``length`` have no windows.  Other columns are only carried."""
    if widths[-1] != 1 or any(a <= b for a, b in zip(widths, widths[1:])):
        raise ValueError("widths: falling, the last 1")
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = rows.select("row", F.col("text").cast("binary").alias("text"), *_identity(F.col("id"), F.col("text")))
    texts = rows.select("u1", "u2", "text").where(F.length("text") >= length)
    marks = _repeated(texts, texts.mapInArrow(_cuts(length, gram), _ddl(_CUTS)), length, gram, widths, limit)
    return rows.join(marks, ["u1", "u2"], "left").select("row", "text", "marks")


def removed(marks: list[dict] | None, text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows (start, end) of the bytes that go, in order; no two touch."""
    if not marks:
        return np.zeros((0, 2), np.int64)
    runs = windows(marks, len(text), length, gram)
    return _joined(runs + [0, length - 1]) + [0, 1]


def keep(text: bytes, gone: np.ndarray) -> bytes:
    ends = [0, *gone[:, 1].tolist()]
    starts = [*gone[:, 0].tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def whole_characters(text: bytes, gone: np.ndarray) -> np.ndarray:
    """``gone`` without characters that it holds only in part."""
    out = []
    for a, b in gone.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def digest(df: DataFrame, id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = spans(df, id_col, length=length, gram=gram, **options)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[], [], [], []]
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                gone = removed(marks.as_py(), text, length, gram)
                left = keep(text, gone)
                for c, x in zip(cols, (len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return found.select(F.col("row")[id_col].alias("doc_id"), "text", "marks").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars",
          length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """``df`` without the repeated passages of its texts; all rows and columns stay.

    A character goes if all its bytes go, so texts stay valid; a null text stays
    null; ``size_col``, where there is one, becomes the new number of characters."""
    found = spans(df, id_col, text_col, length, gram, **options)
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            left = []
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                left.append(keep(text, whole_characters(text, removed(marks.as_py(), text, length, gram))).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string())], names=["row", "left"])

    done = found.mapInArrow(run, f"row struct<{fields}>, left string")
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("left"))
    changed = {text_col: text} | ({size_col: F.length(text).cast(df.schema[size_col].dataType)} if size_col in df.columns else {})
    return done.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in df.columns])
