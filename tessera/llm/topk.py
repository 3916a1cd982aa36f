"""Exact top-k by inner product: aggregation of sorted lists without random access.

Vectors are cut into shards.  A shard has one list per component, sorted by it;
a query reads a list from its largest or smallest end, depending on the sign of
its own component, so the contributions it reads never rise.  After reading all
lists to some depth, a vector's lower bound is what was read of it plus the least
that the unread lists hold; its upper bound takes instead what was read last of
each.  Where that is tighter, both take the product of the lengths of what is unread
of query and vector (a vector's length is stored beside the lists).  Vectors whose
upper bound is under the k-th lower bound, or under the k-th score that the task has
found in earlier shards, are out.  Reading goes on, twice as deep each time and in
sixteenths beyond the half, until few vectors are left in for every query; their
final scores are then summed in whole numbers.

All queries of a batch read together: "read to this depth" is a mask over the
shard, so bounds are matrix products.  Each pair of a shard and a query batch is
one row of an equi-join on a shard group, and sends k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, pick
from tessera.session import materialize

SHARD, BATCH = 4096, 256


class Lists:
    """The sorted lists of one shard (whole numbers, rows are vectors)."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        order = x.argsort(axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty_like(order)  # 0: smallest
        np.put_along_axis(self.rank, order, np.arange(n)[:, None], axis=0)
        self.top = np.abs(x.astype(np.float64)).max(initial=0)
        self.depths: list[int] = []  # how deep each query has read

    def search(self, queries: np.ndarray, k: int, barred: np.ndarray, floor: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores): a set that holds the k best rows of each query,
        all that tie with the k-th included; ``barred`` rows (a mask per query) are
        out, and rows that score under the query's ``floor`` may be missing."""
        n, d = self.x.shape
        exact = float(self.top) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(d, 1) < 2.0**52
        number = np.float64 if exact else object  # products of doubles are exact below 2^53
        up, down = np.maximum(queries, 0).T.astype(number), np.minimum(queries, 0).T.astype(number)
        open_, x, depth = np.arange(len(queries)), self.x.astype(number), max(4 * k, n // 16)
        while len(open_):
            depth = min(depth, n)
            high, low = self.rank >= n - depth, self.rank < depth  # read from the upper and from the lower end
            u, v = up[:, open_], down[:, open_]
            read = (x * high) @ u + (x * low) @ v
            next_high, next_low = self.sorted[n - depth].astype(number), self.sorted[depth - 1].astype(number)
            most = (~high * next_high) @ u + (~low * next_low) @ v
            least = (~high * self.sorted[0].astype(number)) @ u + (~low * self.sorted[-1].astype(number)) @ v
            if exact:
                unread = self._unread(x, high, low, u, v)
                most, least = np.minimum(most, unread), np.maximum(least, -unread)
            upper, lower, still = read + most, read + least, []
            for c, q in enumerate(open_):
                inside = np.flatnonzero(~barred[q])
                kth = -np.inf if floor is None else floor[q]
                if len(inside) > k:
                    bounds = lower[inside, c]
                    kth = max(kth, np.partition(bounds, len(bounds) - k)[len(bounds) - k] if exact else sorted(bounds)[len(bounds) - k])
                inside = inside[upper[inside, c] >= kth]
                if depth == n or len(inside) <= max(4 * k, n // 16):
                    self.depths.append(depth)
                    yield int(q), inside, _scores(self.x[inside], queries[q], exact)
                else:
                    still.append(q)
            open_, depth = np.array(still, np.int64), depth * 2 if 4 * depth <= n else depth + max(1, n // 16)

    @staticmethod
    def _unread(x: np.ndarray, high: np.ndarray, low: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """(rows, queries): the length of what is unread of the row times that of the
        query, rounded up; components on which the query is 0 don't matter."""
        of_query = ~high @ (u * u) + ~low @ (v * v)
        of_row = (x * x * ~high) @ (u > 0) + (x * x * ~low) @ (v < 0)
        return np.ceil(np.sqrt(of_query * of_row) * (1 + 1e-9))


def _scores(x: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products, held within 64 bits."""
    if exact:
        return x @ query
    return np.clip(x.astype(object) @ query.astype(object), -(2**63 - 1), 2**63 - 1).astype(np.int64)


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors of equal length side by side: (size, ids, data)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(size: int) -> pa.RecordBatch:
            part = held.pop(size)
            ids, data = np.array([i for i, _ in part], "<i8"), np.array([v for _, v in part], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], names=["size", "ids", "data"])

        for batch in it:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= rows:
                    yield row(len(v))
        for size in [*held]:
            yield row(size)

    return vectors.mapInArrow(run, "size int, ids binary, data binary")


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 * x) of each component; no row for a null id or
    vector, a vector without components, or null or non-finite components."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(fine) \
        .select("vec_id", F.transform(x, lambda e: F.floor(F.lit(1024.0) * e.cast("double"))).alias("v"))


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, all rows
    but those with its own id being candidates; ties go to the smaller id.

    ``is_query``: over ``vec_id``.  Vectors are compared with those of their own
    length; components and scores beyond 64 bits stand at the largest such number.
    Repeated query rows are queries of their own; an empty table or no
    query gives no rows; other columns aren't read."""
    vectors = quantised(pick(df, vec_id=id_col, embedding=vector_col).withColumn("vec_id", F.col("vec_id").cast("long")))
    shards = materialize(_packed(vectors, SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = materialize(_packed(vectors.where(is_query).coalesce(1 + shards.rdd.getNumPartitions() // 8), BATCH)
                        .withColumn("batch", F.monotonically_increasing_id()), "query-batches")
    groups = min(partitions(df), max(1, shards.count()))
    dealt = asked.select("size", "batch", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    # by merging: the batches look small enough for a broadcast, which would hold all their copies, one per group, on the driver
    pairs = shards.withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")).join(dealt.hint("merge"), ["g", "size"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists, ids = None, None, None
        kept: dict[int, np.ndarray] = {}  # by batch of queries: the k best scores so far, ascending
        for b in it:
            for i in range(b.num_rows):
                size, shard, batch = (b.column(c)[i].as_py() for c in ("size", "shard", "batch"))
                if shard != at:
                    ids = np.frombuffer(b.column("ids")[i].as_py(), "<i8")
                    at, lists = shard, Lists(np.frombuffer(b.column("data")[i].as_py(), "<i8").reshape(-1, size))
                q_ids = np.frombuffer(b.column("q_ids")[i].as_py(), "<i8")
                queries = np.frombuffer(b.column("q_data")[i].as_py(), "<i8").reshape(-1, size)
                cols: list[list] = [[], [], [], [], []]
                held = kept.setdefault(batch, np.full((len(queries), k), -np.inf))
                for q, rows, scores in lists.search(queries, k, q_ids[:, None] == ids[None, :], held[:, 0].copy()):
                    best = np.lexsort((ids[rows], -scores))[:k]
                    held[q] = np.sort(np.concatenate([held[q], scores[best].astype(np.float64)]))[-k:]
                    best = best[scores[best] >= held[q, 0]]
                    for c, x in zip(cols, ([batch] * len(best), [q] * len(best), [q_ids[q]] * len(best), ids[rows[best]], scores[best]), strict=True):
                        c.extend(map(int, x))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["batch", "q", "query_id", "vec_id", "score"])

    found = pairs.sortWithinPartitions("shard").mapInArrow(run, "batch long, q long, query_id long, vec_id long, score long")
    place = Window.partitionBy("batch", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
