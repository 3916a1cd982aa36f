"""Hard negatives by segment summaries.

A vector is cut into segments; a segment's mean and deviation are stored, scaled
so that with a = sqrt(m) * mean and b = sqrt(sum of squared differences from the
mean) the inner product of two segments lies within a * a' +- b * b'.  Summed over
the segments these are bounds of a score.  Level 0 has one segment, each further
level halves them; a row whose bounds can't change what a query returns is out
and isn't looked at by the finer level.  What is left after the last level is
scored exactly, in whole numbers.

A query is a vector with windows of scores (low, high): wanted are the k best
rows in each window, among the rows of the query's label or among all others.
Positives have one open window; the windows of the negatives follow from the
positives' scores.  Both searches pair packed blocks of rows and queries by an
equi-join; a task keeps a query's k-th best score from block to block, so later
blocks are cut by what earlier ones gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, pick
from tessera.session import materialize

#: Rows and queries of a block; components of the finest segments.
ROWS, QUERIES, FINEST = 4096, 256, 2
#: Bounds are widened by this part of the product of the lengths, against rounding.
ROUNDING = 1e-9
_FAR = 1 << 62


def levels(size: int, finest: int = FINEST) -> list[np.ndarray]:
    """Starts of the segments of each level; halves, down to about ``finest`` components."""
    out, n = [], 1
    while True:
        out.append(np.unique(np.arange(n) * size // n))
        if size <= n * finest:
            return out
        n *= 2


def summaries(x: np.ndarray, finest: int = FINEST) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the scaled means and deviations of the rows' segments."""
    x, out = x.astype(np.float64), []
    for starts in levels(x.shape[1], finest):
        sizes = np.diff(np.append(starts, x.shape[1]))
        means = np.add.reduceat(x, starts, axis=1) / sizes
        off = x - np.repeat(means, sizes, axis=1)
        out.append((means * np.sqrt(sizes), np.sqrt(np.add.reduceat(off * off, starts, axis=1))))
    return out


class Block:
    """Rows of one length with their labels and summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, stored: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.labels, self.x, self.stored = ids, labels, x, stored
        self.lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.top = np.abs(x.astype(np.float64)).max(initial=0)
        self.as_float = x.astype(np.float64)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> list[int] | np.ndarray:
        """Exact inner products, held within 62 bits."""
        if self.top * np.abs(query.astype(np.float64)).max(initial=0) * max(1, len(query)) < 2.0**52:
            return (self.as_float[rows] @ query.astype(np.float64)).astype(np.int64)  # products of doubles are exact below 2^53
        return np.clip(self.x[rows].astype(object) @ query.astype(object), -_FAR, _FAR).astype(np.int64)

    def search(self, rows: np.ndarray, query: np.ndarray, stored: list[tuple[np.ndarray, np.ndarray]], windows: list[tuple[int, int]],
               least: list[int], k: int, looked: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, rows, scores): of ``rows``, a set that holds the ``k`` best in
        each window with all that tie with the k-th; rows under the window's
        ``least`` may be missing.  ``looked`` counts the rows seen by each level
        and, at the end, those scored."""
        wide = self.lengths * float(np.sqrt((query.astype(np.float64) ** 2).sum())) * ROUNDING + 1
        for level, ((a, b), (qa, qb)) in enumerate(zip(self.stored, stored, strict=True)):
            if looked is not None:
                looked[level] += len(rows)
            middle, spread = a[rows] @ qa, b[rows] @ qb + wide[rows]
            low, high, some = middle - spread, middle + spread, np.zeros(len(rows), bool)
            for (bottom, top), floor in zip(windows, least, strict=True):
                inside = low[(low >= bottom) & (high <= top)]  # surely in the window
                if len(inside) >= k:
                    floor = max(floor, np.partition(inside, len(inside) - k)[len(inside) - k])
                some |= (high >= max(bottom, floor)) & (low <= top)
            rows = rows[some]
            if not len(rows):
                return
        if looked is not None:
            looked[-1] += len(rows)
        scores = self.scores(rows, query)
        for no, (bottom, top) in enumerate(windows):
            fine = (scores >= max(bottom, least[no])) & (scores <= top)
            if fine.any():
                yield no, rows[fine], scores[fine]


def _packed(vectors: DataFrame, rows: int, carried: str, kind: str) -> DataFrame:
    """Vectors of equal length side by side, with their summaries: (block, size, ids,
    labels, data, stored, ``carried`` as an array)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, {}

        def row(size: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            part = held.pop(size)
            x = np.array([r[2] for r in part], "<i8")
            stored = b"".join(np.ascontiguousarray(m, "<f8").tobytes() for pair in summaries(x) for m in pair)
            ids, labels = (np.array([r[c] for r in part], "<i8").tobytes() for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int32()), pa.array([ids]), pa.array([labels]),
                                               pa.array([x.tobytes()]), pa.array([stored]), pa.array([[r[3] for r in part]], out)],
                                              names=["block", "size", "ids", "labels", "data", "stored", carried])

        for b in it:
            out = pa.list_(b.schema.field(3).type)
            for i, label, v, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, label, v.values.to_numpy(zero_copy_only=False), more))
                if len(held[len(v)]) >= rows:
                    yield row(len(v))
        for size in [*held]:
            yield row(size)

    return materialize(vectors.mapInArrow(run, f"block long, size int, ids binary, labels binary, data binary, stored binary, {carried} array<{kind}>"), carried)


def _stored(data: bytes, rows: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    flat, at, out = np.frombuffer(data, "<f8"), 0, []
    for starts in levels(size):
        cells = rows * len(starts)
        out.append((flat[at:at + cells].reshape(rows, -1), flat[at + cells:at + 2 * cells].reshape(rows, -1)))
        at += 2 * cells
    return out


def _search(rows: DataFrame, queries: DataFrame, same: bool, k: int, groups: int) -> DataFrame:
    """(anchor, window, vec_id, score): per task, the k best of each query and window.
    ``queries`` carries ``asked``: (anchor, windows) of each query."""
    dealt = queries.select("size", F.col("block").alias("asked_by"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "data", "stored")], "asked",
                           F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    # by merging: the queries look small enough for a broadcast, which would hold all their copies, one per group, on the driver
    pairs = rows.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(dealt.hint("merge"), ["g", "size"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, best = None, [], []
        number = lambda raw: np.frombuffer(raw.as_py(), "<i8")

        def out() -> pa.RecordBatch:
            found = [(asked[q]["anchor"], w, i, s) for q, part in enumerate(best) for w, top in enumerate(part) for s, i in top]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4,
                                              names=["anchor", "window", "vec_id", "score"])

        for b in it:
            for r in range(b.num_rows):
                cell = lambda c: b.column(c)[r]  # noqa: B023, E731
                size = cell("size").as_py()
                if cell("asked_by").as_py() != at:
                    if best:
                        yield out()
                    at, asked = cell("asked_by").as_py(), cell("asked").as_py()
                    q_ids, q_labels, q = number(cell("q_ids")), number(cell("q_labels")), number(cell("q_data")).reshape(-1, size)
                    q_stored = _stored(cell("q_stored").as_py(), len(q), size)
                    best = [[[] for _ in a["windows"]] for a in asked]
                ids, x = number(cell("ids")), number(cell("data")).reshape(-1, size)
                block = Block(ids, number(cell("labels")), x, _stored(cell("stored").as_py(), len(x), size))
                for i, one in enumerate(asked):
                    may = (block.labels == q_labels[i]) & (block.ids != q_ids[i]) if same else block.labels != q_labels[i]
                    windows = [(w["low"], w["high"]) for w in one["windows"]]
                    least = [top[-1][0] if len(top) == k else -_FAR for top in best[i]]
                    mine = [(a[i], d[i]) for a, d in q_stored]
                    for no, hit, scores in block.search(np.flatnonzero(may), q[i], mine, windows, least, k):
                        some = np.lexsort((block.ids[hit], -scores))[:k]
                        both = best[i][no] + [*zip(scores[some].tolist(), block.ids[hit[some]].tolist(), strict=True)]
                        best[i][no] = sorted(both, key=lambda t: (-t[0], t[1]))[:k]
        if best:
            yield out()

    return pairs.sortWithinPartitions("asked_by").mapInArrow(run, "anchor long, window long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def quantised(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component; no row for a null id, label or
    vector, a vector without components, or null or non-finite components."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(fine) \
        .select("vec_id", "label", F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, label: Column | None = None,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    each anchor and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels that score between ``low`` and ``high``
    percent of the positive's score.

    ``is_anchor`` and ``label`` (what counts as the label) are over ``vec_id`` and
    ``label``.  Scores are inner products in whole numbers; ties go to the smaller id.
    Vectors are compared with those of their own length; products beyond 62 bits
    stand at the largest such number.  Rows with the anchor's id are never its
    positives; repeated rows are rows of their own, so a repeated anchor gives its rows
    again.  A positive score below 0 has no negatives, since the window is empty.  An
    empty table or no anchor gives no rows; other columns aren't read."""
    flat = pick(df, vec_id=id_col, embedding=vector_col, label=label_col)
    flat = flat.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("label", F.col("label").cast("long"))
    vectors = quantised(flat).withColumn("label", (F.col("label") if label is None else label).cast("long"))
    rows = _packed(vectors.select("vec_id", "label", "v", F.lit(0).alias("none")), ROWS, "none", "int")
    groups = min(partitions(df), max(1, rows.count()))
    anchors = materialize(vectors.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    anchors_in = anchors.coalesce(1 + anchors.rdd.getNumPartitions() // 8)
    windows = "array<struct<low: bigint, high: bigint>>"
    ask = f"struct<anchor: bigint, windows: {windows}>"
    wide = F.struct("anchor", F.array(F.struct(F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"))).alias("windows")).cast(ask)
    asked = _packed(anchors_in.select("vec_id", "label", "v", wide.alias("asked")), QUERIES, "asked", ask)
    near = _first(_search(rows, asked, True, positives, groups), positives)
    near = materialize(near.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # low * positive <= 100 * negative <= high * positive
    bound = lambda share, up: F.expr(f"cast({'ceil' if up else 'floor'}(cast(positive_score as decimal(20, 0)) * {int(share)} / 100) as bigint)")
    per = near.withColumn("low", bound(low, True)).withColumn("high", bound(high, False))
    per = per.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", "low", "high"))).alias("w"))  # at most ``positives``
    per = per.select("anchor", F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    narrow = anchors.join(per, "anchor").select("vec_id", "label", "v", F.struct("anchor", "windows").cast(ask).alias("asked"))
    asked = _packed(narrow.coalesce(1 + anchors.rdd.getNumPartitions() // 8), QUERIES, "asked", ask)
    hard = _first(_search(rows, asked, False, negatives, groups), negatives)
    return hard.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(near, ["anchor", "window"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor") \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
