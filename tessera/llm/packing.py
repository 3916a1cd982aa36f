"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

A document's ids with its end id are cut into pieces only where they exceed the
capacity.  How the pieces go into sequences depends on the histogram of piece
lengths alone, which has at most ``capacity`` entries whatever the corpus:

* The configuration linear program has one variable per way to fill a sequence
  and one constraint per length (all its pieces are covered); it minimises the
  number of sequences.  Multiplicative weights hold a price per length; a
  knapsack dynamic program over the capacity finds the fillings of highest
  price, through each length that still needs one; each round raises the prices
  of lengths that lag behind and lowers the others.  Rounds go on until at most
  ``GAP`` of all tokens is uncovered.  Prices over the best filling's price are a
  solution of the dual, so every round bounds the number of sequences from below.
* The fractional solution is rounded down, then up by largest fraction as long as
  there are pieces; best fit in descending length packs what is left, whole runs of
  equal pieces at a time.

The result is a list of runs (length, first rank, count, sequence, offset); a
piece finds its run by its rank among the pieces of its length, which is counted
per (length, salt) so that a length that a third of all pieces share is spread.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, pick, strings
from tessera.llm.tokens import tokenizer
from tessera.session import materialize

#: Most rounds of the weights, their rate, how near the best price a filling must
#: be, and the part of all tokens that may stay uncovered.
ROUNDS, RATE, NEAR, GAP = 300, 0.5, 0.005, 0.01


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room 0..capacity the best total price (each length as often as
    it fits), and the index of the length to take first (-1: none)."""
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")  # lengths ascend
    for room in range(int(lengths[0]), capacity + 1):
        value = best[room - lengths[: upto[room]]] + prices[: upto[room]]
        i = int(value.argmax())
        best[room], first[room] = value[i], i
    return best, first


def fill(room: int, first: list[int], lengths: list[int]) -> list[int]:
    """Indices of the lengths that the dynamic program puts into ``room``."""
    out = []
    while (i := first[room]) >= 0:
        out.append(i)
        room -= lengths[i]
    return out


def linear_program(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """Fillings (sorted indices of lengths) and how often each is used, and a lower
    bound on the sequences.  Together the fillings use no length more often than it
    occurs and leave at most ``GAP`` of all tokens, if ``ROUNDS`` are enough."""
    used: dict[tuple[int, ...], float] = defaultdict(float)
    left, weight, bound = counts.astype(float), np.ones(len(lengths)), 0.0
    for _ in range(ROUNDS):
        open_ = np.flatnonzero(left > 1e-6)
        if float((left * lengths).sum()) <= GAP * float((counts * lengths).sum()):
            break
        size = lengths[open_]
        price = size * weight[open_]
        best, first = knapsack(size, price, capacity)
        bound = max(bound, float((counts[open_] * price).sum()) / float(best[capacity]))
        through = price + best[capacity - size]  # the best filling that has this length
        near = np.flatnonzero(through >= (1 - NEAR) * best[capacity])
        first, sizes, names, rest = first.tolist(), size.tolist(), open_.tolist(), left.tolist()
        for i in near[np.argsort(-through[near], kind="stable")].tolist():
            filling = sorted(names[j] for j in (i, *fill(capacity - sizes[i], first, sizes)))
            parts = Counter(filling)
            times = min(rest[j] / n for j, n in parts.items())  # a fraction, where a length stands in it several times
            if times <= 1e-9:
                continue
            used[tuple(filling)] += times
            for j, n in parts.items():
                rest[j] -= times * n
        done, left = (left - rest) / counts, np.array(rest)
        weight *= np.exp(-RATE * (done - np.average(done, weights=lengths * counts)))
    return used, bound


def rounded(used: dict[tuple[int, ...], float], counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole numbers of the fillings: rounded down, then one more of each by largest
    fraction while its pieces are there; and the pieces left."""
    left, times = counts.copy(), {f: int(x + 1e-9) for f, x in used.items()}
    for f, n in times.items():
        np.subtract.at(left, list(f), n)
    for f, x in sorted(used.items(), key=lambda y: (-(y[1] - times[y[0]]), y[0])):
        parts, n = np.unique(f, return_counts=True)
        if x - times[f] > 1e-9 and (left[parts] >= n).all():
            left[parts] -= n
            times[f] += 1
    return [(f, n) for f, n in times.items() if n], left


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in descending length, a run of equal pieces at a time:
    (indices of lengths, number of such sequences)."""
    groups: dict[int, list[list]] = {}  # by room: [filling, sequences]
    rooms: list[int] = []  # ascending

    def add(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append([filling, n])

    for i in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[i]), int(left[i])
        while n:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                each = min(capacity // size, n)
                add(capacity - each * size, (i,) * each, n // each)
                n -= each * (n // each)
                continue
            room = rooms[k]
            filling, there = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[k]
            take = min(n, there)
            if take < there:
                add(room, filling, there - take)
            add(room - size, (*filling, i), take)
            n -= take
    return [(f, n) for g in groups.values() for f, n in g]


def plan(histogram: dict[int, int], capacity: int, report: dict | None = None) -> tuple[np.ndarray, int]:
    """Runs as rows (length, first rank, sequence, offset), by length and rank,
    and the number of sequences.  ``report`` gets the program's value, the dual
    bound, and how many pieces its fillings place; whole sequences aside."""
    rows, sequence = [], 0
    rank: dict[int, int] = defaultdict(int)
    lengths = np.array(sorted(x for x in histogram if x < capacity), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    fillings: list[tuple[tuple[int, ...], int]] = []
    if len(lengths):
        used, bound = linear_program(lengths, counts, capacity)
        fillings, left = rounded(used, counts)
        if report is not None:
            report |= {"value": sum(used.values()), "bound": bound, "placed": int((counts - left).sum()), "pieces": int(counts.sum())}
        fillings += best_fit(lengths, left, capacity)
    full = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    for sizes, n in full + [(tuple(int(lengths[i]) for i in f), n) for f, n in fillings]:
        offset = 0
        for size in sizes:
            rows.append((size, rank[size], sequence, offset))
            rank[size] += n
            offset += size
        sequence += n
    assert dict(rank) == dict(histogram)
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequence


def pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(tokenizer_path)
        for batch in it:
            keys, out = batch.column(0), []
            texts = strings(batch.column(1))
            at = 0
            for low in range(0, len(texts), 256):
                for ids in model.encode(texts[low:low + 256]):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    out += [(at, k, s, min(capacity, len(ids) - s), zlib.crc32(ids[s:s + capacity].tobytes()))
                            for k, s in enumerate(range(0, len(ids), capacity))]
                    at += 1
            which, *cols = map(list, zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(which, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def ranked(cut: DataFrame, by: str) -> DataFrame:
    """``rank``: the row's place, from 0, among the rows with its ``by``."""
    salts = partitions(cut)
    cut = materialize(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces") \
        .withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
    before = cut.groupBy(by, "salt").agg(F.count("*").alias("n")).select(
        by, "salt", (F.sum("n").over(Window.partitionBy(by).orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(by, "salt").orderBy("rid"))
    return cut.withColumn("inside", inside).join(before, [by, "salt"]) \
        .withColumn("rank", F.col("before") + F.col("inside") - 1).drop("before", "inside", "salt", "rid")


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty (its end id alone is its only piece); null and repeated
    ids are packed row by row; an empty table gives no rows; other columns are
    not read.
    """
    cut = ranked(pieces(df, tokenizer_path, end_id, capacity, id_col, text_col), "length")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs, _ = plan(histogram, capacity)
    # a run's key is its length and first rank; the array is bounded by the histogram, not by the corpus
    stride = max(histogram.values(), default=0) + 1
    keys = runs[:, 0] * stride + runs[:, 1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * stride + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])],
                names=[*b.schema.names[:-1], "sequence_id", "offset"])

    cut = cut.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
