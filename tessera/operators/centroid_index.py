"""Approximate vector retrieval (J1 c) through an inverted file of centroids.

Centroids are fitted by k-means on a bounded sample (``SAMPLE_BYTES`` of vectors);
every row of the corpus goes to the list of its nearest centroid.  A question
probes the lists of its nearest centroids.  How many is calibrated when the index
is made: rows of the sample are asked, and the number of lists is the least that
holds ``RECALL`` of their nearest rows of the sample (in the whole corpus nearer
ones exist, so less is missed).  With all lists probed the result is the exact one.

A list is stored in blocks of ``BLOCK`` rows and a large one is split by salt over
several tasks.  Blocks of ``QUESTIONS`` questions, with the lists that each probes,
meet the lists' blocks on a grid (:mod:`tessera.operators.blocks`), and a task scores
a block for the questions that probe its list.  A question is copied once per row of the
grid, however many lists it probes; neither a list with a third of the rows nor one that
all questions probe stays in one task, and no (question, list) or (question, row) pair is a
row of the plan.  A task keeps the best ``k`` of each question.

``path/centroids``  (list, centre, n, salts, probes), ``probes`` the calibrated number
``path/lists``      (shard, list, id columns as arrays, vec as bytes), ``shard`` numbers the blocks
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import retrieve
from tessera.operators.blocks import meet
from tessera.session import BLOCK_ROWS, materialize, work_dir

SAMPLE_BYTES = 64 << 20  # of vectors that the centroids are fitted on, about
MOST_LISTS = 4096
ROUNDS = 12  # of k-means
RECALL, ASKED = 0.97, 1024  # of the calibration, and the rows of the sample that are asked
BLOCK, SPLIT = 4096, 16  # rows of a block, blocks of a salt
QUESTIONS = 4096  # of a block
CELLS = 1 << 20  # scores that the driver holds at once while it fits and calibrates


@dataclass(frozen=True)
class CentroidIndex:
    path: str
    ids: tuple[str, ...]

    def centroids(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(os.path.join(self.path, "centroids"))

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(os.path.join(self.path, "lists"))


def fit(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors: k-means by cosine, started from rows far from
    one another; a centroid that loses all its rows moves to the row that its own
    serves worst."""
    rng = np.random.default_rng(seed)
    rows = retrieve._normalise(np.asarray(sample, np.float64))
    lists = max(1, min(lists, len(np.unique(rows, axis=0))))
    centres = [rows[rng.integers(len(rows))]]
    nearest = rows @ centres[0]
    while len(centres) < lists:
        far = np.maximum(1 - nearest, 0) + 1e-12
        centres.append(rows[rng.choice(len(rows), p=far / far.sum())])
        nearest = np.maximum(nearest, rows @ centres[-1])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own, score = _own(rows, c)
        sums = np.zeros_like(c)
        for part in _parts(len(rows), rows.shape[1]):
            np.add.at(sums, own[part], rows[part])
        for lost in np.flatnonzero(np.bincount(own, minlength=lists) == 0):
            worst = score.argmin()
            sums[lost], own[worst], score[worst] = rows[worst], lost, np.inf
        c = retrieve._normalise(sums)
    return c


def _parts(n: int, width: int):
    """Slices of ``n`` rows with about ``CELLS`` cells each."""
    step = max(1, CELLS // max(1, width))
    return (slice(lo, lo + step) for lo in range(0, n, step))


def _own(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its score."""
    own, best = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for part in _parts(len(rows), len(centres)):
        score = rows[part] @ centres.T
        own[part], best[part] = score.argmax(axis=1), score.max(axis=1)
    return own, best


def calibrated(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The least number of lists probed that finds ``target`` of the ``k`` nearest rows."""
    rows = retrieve._normalise(np.asarray(sample, np.float64))
    own, asked = _own(rows, centres)[0], rows[:ASKED]
    k = min(k, len(rows) - 1)
    if k < 1:
        return len(centres)
    places = []
    for part in _parts(len(asked), len(rows)):
        score = -(asked[part] @ rows.T)
        score[np.arange(len(score)), np.arange(part.start, part.start + len(score))] = np.inf
        near = np.argpartition(score, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(asked[part] @ centres.T), axis=1), axis=1)
        places.append(place[np.arange(len(place))[:, None], own[near]].ravel())
    places = np.sort(np.concatenate(places))
    return int(places[int(np.ceil(target * len(places))) - 1]) + 1


def _matrix(vectors: DataFrame) -> np.ndarray:
    """The vectors of a bounded frame of one column, one per row."""
    return retrieve._vectors(vectors.toArrow().column(0).combine_chunks())


def _nearest(centres: np.ndarray, probes: int, vec: str, out: str):
    """Adds ``out``: the numbers of the ``probes`` nearest centroids, nearest first."""

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            if not rb.num_rows:
                continue
            score = np.round(retrieve._normalise(retrieve._vectors(rb.column(vec))) @ centres.T, 9)
            best = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*rb.columns, lists], names=[*rb.schema.names, out])

    return run


def _probed(centres: np.ndarray, probes: int):
    """Adds to blocks of questions ``lists``: the numbers of the ``probes`` nearest
    centroids of each, as the bytes of 16-bit numbers."""

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            for i in range(rb.num_rows):
                q = retrieve._matrix(rb, i, "qvec", len(rb.column("qid")[i].values))
                parts = (np.argsort(-np.round(q[part] @ centres.T, 9), axis=1, kind="stable")[:, :probes] for part in _parts(len(q), len(centres)))
                near = np.concatenate([*parts]).astype(np.int16)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in rb.columns), pa.array([near.tobytes()], pa.binary())], names=[*rb.schema.names, "lists"])

    return run


def _blocks(ids: list[str]):
    """Rows that follow one another by (list, salt) to blocks."""

    def run(batches):
        import pyarrow as pa

        number, held, key = TaskContext.get().partitionId() << 33, [], None

        def block():
            nonlocal number
            number += 1
            cells = retrieve._vector_block([[rb.column(c) for c in ids] for rb in held], [rb.column("vec") for rb in held], True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([key[0]], pa.int32()), *cells], names=["shard", "list", *ids, "vec"])

        for rb in batches:
            at, salt = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("list", "salt"))
            new = np.flatnonzero(np.diff(at) | np.diff(salt)) + 1
            for a, b in zip([0, *new], [*new, rb.num_rows]):
                if held and (key != (at[a], salt[a])):
                    yield block()
                key = (int(at[a]), int(salt[a])) if b > a else key
                while a < b:
                    n = min(b - a, BLOCK - sum(x.num_rows for x in held))
                    held.append(rb.slice(a, n))
                    a += n
                    if sum(x.num_rows for x in held) >= BLOCK:
                        yield block()
        if held:
            yield block()

    return run


def write(corpus: DataFrame, path: str, id_col: str | list[str] = "id", vec_col: str = "embedding", lists: int | None = None) -> CentroidIndex:
    """Index every row of ``corpus`` at ``path``.  ``lists``: by default the square
    root of the rows, ``MOST_LISTS`` at most (their centroids go to every task)."""
    spark, ids = corpus.sparkSession, retrieve._ids(id_col)
    rows = corpus.select(*[F.col(c).cast("long").alias(c) for c in ids], F.col(vec_col).cast("array<double>").alias("vec"))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n:
        most = max(1, SAMPLE_BYTES // (8 * max(1, dims)))
        # by a hash of the ids: the same rows in every run
        kept = rows.where(F.pmod(F.xxhash64(*ids), F.lit(-(-n // most))) == 0).orderBy(F.xxhash64(F.lit(1), *ids)).select("vec").limit(most)
        # as Arrow: on the driver no row is an object
        sample = _matrix(kept)
        sample = sample if len(sample) else _matrix(rows.select("vec").limit(1))
        centres = fit(sample, min(MOST_LISTS, lists or max(1, round(n**0.5))))
        probes = calibrated(sample, centres, retrieve.TOP_K, RECALL)
    else:
        centres, probes = np.zeros((0, 0)), 0
    placed = rows.withColumn("near", F.array().cast("array<int>"))
    if n:
        placed = rows.mapInArrow(_nearest(centres, 1, "vec", "near"), T.StructType([*rows.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))]))
    placed = materialize(placed.withColumn("list", F.get("near", F.lit(0))).drop("near"), "placed")
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per list
    table = [(i, [float(x) for x in c], -(-sizes.get(i, 0) // (BLOCK * SPLIT)), sizes.get(i, 0), probes) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "list int, centre array<double>, salts int, n long, probes int").coalesce(1).write.parquet(os.path.join(path, "centroids"))
    index = CentroidIndex(path, tuple(ids))
    salts = F.broadcast(index.centroids(spark).select("list", "salts"))
    salted = placed.join(salts, "list").withColumn("salt", F.pmod(F.xxhash64(*ids), "salts").cast("int")).select("list", "salt", *ids, "vec")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("list", T.IntegerType()),
                           *(T.StructField(c, T.ArrayType(T.LongType())) for c in ids), T.StructField("vec", T.BinaryType())])
    salted.repartition(tasks, "list", "salt").sortWithinPartitions("list", "salt").mapInArrow(_blocks(ids), schema) \
        .write.options(**BLOCK_ROWS).parquet(os.path.join(path, "lists"))
    return index


def build(corpus: DataFrame, id_col: str | list[str] = "id", vec_col: str = "embedding", lists: int | None = None, name: str = "centroids") -> CentroidIndex:
    """:func:`write` to a new folder in the shared scratch place."""
    return write(corpus, work_dir(corpus.sparkSession, name), id_col, vec_col, lists)


def topk(index: CentroidIndex, questions: DataFrame, k: int = retrieve.TOP_K, probes: int | None = 0, qid_col: str = "qid",
         qvec_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``(qid, rank, *ids, score)``: the best ``k`` rows by cosine in the ``probes``
    lists nearest to each question (0: the calibrated number; None: all lists, the
    exact result)."""
    spark, ids = questions.sparkSession, list(index.ids)
    centroids = index.centroids(spark)
    found = centroids.orderBy("list").collect()  # MOST_LISTS at most
    centres = [r.centre for r in found]
    if probes == 0 and found:
        probes = found[0].probes
    rows = questions.select(F.col(qid_col).alias("qid"), F.col(qvec_col).cast("array<double>").alias("qvec"))
    if not centres:
        return retrieve.rank_topk(spark.createDataFrame([], T.StructType([rows.schema["qid"], *(T.StructField(c, T.LongType()) for c in ids), T.StructField("score", T.DoubleType())])), ids, k)
    asked = retrieve.pack_vectors(rows, ["qid"], "qvec", QUESTIONS, "question-blocks", "qblock")
    if probes and probes < len(centres):
        asked = materialize(asked.mapInArrow(_probed(np.array(centres), probes), T.StructType([*asked.schema.fields, T.StructField("lists", T.BinaryType())])), "probed", BLOCK_ROWS)
    found = retrieve.best_rows(meet(index.lists(spark), asked, "shard", "qblock"), rows.schema["qid"].dataType, ids, k,
                               retrieve.cosine_pairs(ids, exclude_self, retrieve.CELL_BUDGET))
    return retrieve.rank_topk(found, ids, k)


def recall(found: DataFrame, exact: DataFrame, ids: list[str]) -> float:
    """The part of the rows of ``exact`` that ``found`` holds."""
    n = exact.count()
    return exact.join(found, ["qid", *ids], "left_semi").count() / n if n else 1.0
