"""Vectors with meaning (V2): latent semantic vectors of the corpus.

Texts are rows of a sparse matrix over ``FEATURES`` hashed terms, ln(1 + tf) * ln(N /
df), scaled to length 1.  Its leading right singular vectors are found by a randomised
range finder (Halko, Martinsson & Tropp, 2011): a random combination of all rows
spans nearly the same space, and one more pass over the rows sharpens it.

1. One pass counts documents per feature.
2. Every task adds up its rows times random numbers, which follow from the row's id;
   the sums of all tasks are added by blocks of features on the executors.
3. The same with the rows' own coordinates in that space (``sharpen`` times).
4. A small Gram matrix of the coordinates gives the axes in order of what they explain.

The driver and each task hold matrices of ``FEATURES`` x (``width`` + ``EXTRA``)
numbers, whatever the corpus.  A text's vector is its row in the new axes, scaled to
length 1; texts that share no term are near each other if their terms go together.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import terms
from tessera.session import materialize, work_dir

FEATURES = 1 << 15
EXTRA = 16  # directions beyond the width, for accuracy
STRIPE = 1024  # features of a block of sums
CELLS = 1 << 22  # numbers held at once when sparse rows are multiplied


@dataclass(frozen=True)
class LatentModel:
    """``path/features`` (feature, idf, axes): a row of the basis per feature that occurs."""

    path: str
    width: int

    def load(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
        """(idf by feature, basis (features, width)); bounded by ``FEATURES``."""
        idf, basis = np.zeros(FEATURES), np.zeros((FEATURES, self.width))
        for r in spark.read.parquet(os.path.join(self.path, "features")).toLocalIterator():
            idf[r.feature], basis[r.feature] = r.idf, r.axes
        return idf, basis


def _features(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    hashed = F.transform(terms(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES)).cast("int"))
    return df.select(*keep, hashed.alias("_f"))


def _sparse(lists, idf: np.ndarray | None):
    """(row, feature, value) of an Arrow list of features, by row; rows have length 1."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    cell, tf = np.unique(row * np.int64(FEATURES) + lists.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    row, feature = np.divmod(cell, FEATURES)
    if idf is None:
        return row, feature, None
    value = np.log1p(tf) * idf[feature]
    length = np.sqrt(np.bincount(row, value * value, minlength=len(lists)))
    return row, feature, value / np.where(length[row] > 0, length[row], 1)


def _pieces(row: np.ndarray, columns: int):
    """Slices of whole rows with about CELLS / columns entries."""
    most, at = max(1, CELLS // columns), 0
    while at < len(row):
        stop = min(len(row), at + most)
        if stop < len(row):
            first = int(np.searchsorted(row, row[stop]))  # of the row that would be cut
            stop = first if first > at else int(np.searchsorted(row, row[stop], side="right"))
        yield slice(at, stop)
        at = stop


def _times(row, feature, value, basis: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows times ``basis``."""
    out = np.zeros((n, basis.shape[1]))
    for part in _pieces(row, basis.shape[1]):
        own, first = np.unique(row[part], return_index=True)
        out[own] = np.add.reduceat(basis[feature[part]] * value[part][:, None], first, axis=0)
    return out


def _add(row, feature, value, factors: np.ndarray, sums: np.ndarray) -> None:
    """Adds the transposed sparse rows times ``factors`` to ``sums``."""
    for part in _pieces(row, factors.shape[1]):
        order = np.argsort(feature[part], kind="stable")
        own, first = np.unique(feature[part][order], return_index=True)
        sums[own] += np.add.reduceat(factors[row[part][order]] * value[part][order][:, None], first, axis=0)


def _sketch(idf: np.ndarray, columns: int, seed: int, basis: np.ndarray | None):
    """Per task: sums of the rows times random numbers, or times their own
    coordinates in ``basis``, as (stripe, data)."""

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((FEATURES, columns))
        for rb in batches:
            row, feature, value = _sparse(rb.column("_f"), idf)
            if basis is None:
                keys = rb.column("_h").to_numpy(zero_copy_only=False)
                factors = np.stack([np.random.default_rng([seed, int(k) & (1 << 64) - 1]).standard_normal(columns) for k in keys]) if len(keys) else np.zeros((0, columns))
            else:
                factors = _times(row, feature, value, basis, rb.num_rows)
            _add(row, feature, value, factors, sums)
        for s in range(0, FEATURES, STRIPE):
            if sums[s:s + STRIPE].any():
                yield pa.RecordBatch.from_arrays([pa.array([s // STRIPE], pa.int32()), pa.array([sums[s:s + STRIPE].tobytes()])], names=["stripe", "data"])

    return run


def _added(batches):
    """(stripe, data) sorted by stripe, to one row per stripe."""
    import pyarrow as pa

    at, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()])], names=["stripe", "data"])
    for rb in batches:
        for s, data in zip(rb.column(0).to_pylist(), rb.column(1)):
            part = np.frombuffer(data.as_py())
            if s != at:
                if total is not None:
                    yield row()
                at, total = s, np.zeros(len(part))
            total += part
    if total is not None:
        yield row()


def _range(rows: DataFrame, idf: np.ndarray, columns: int, seed: int, basis: np.ndarray | None) -> np.ndarray:
    """An orthonormal basis (features, columns) of the space of the sums."""
    schema = "stripe int, data binary"
    parts = rows.mapInArrow(_sketch(idf, columns, seed, basis), schema)
    added = parts.repartition(FEATURES // STRIPE, "stripe").sortWithinPartitions("stripe").mapInArrow(_added, schema)
    sums = np.zeros((FEATURES, columns))
    for r in added.collect():  # FEATURES x columns numbers
        sums[r.stripe * STRIPE:(r.stripe + 1) * STRIPE] = np.frombuffer(r.data).reshape(-1, columns)
    return np.linalg.qr(sums)[0]


def _gram(idf: np.ndarray, basis: np.ndarray):
    def run(batches):
        import pyarrow as pa

        total = np.zeros((basis.shape[1], basis.shape[1]))
        for rb in batches:
            z = _times(*_sparse(rb.column("_f"), idf), basis, rb.num_rows)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["data"])

    return run


def fit(docs: DataFrame, id_col: str, text_col: str, width: int = 256, seed: int = 0, sharpen: int = 2, path: str | None = None) -> LatentModel:
    """The axes of the corpus, written to ``path`` (by default in the shared scratch
    place).  Null texts and texts without terms count as documents and add nothing;
    axes that explain nothing are zero."""
    spark = docs.sparkSession
    rows = materialize(_features(docs.withColumn("_h", F.xxhash64(F.col(id_col))), ["_h"], text_col), "latent-rows")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.coalesce(tasks)  # a task's sums are one matrix, however many splits it reads
    n = rows.count()

    def count(batches):
        import pyarrow as pa

        df = np.zeros(FEATURES, np.int64)
        for rb in batches:
            np.add.at(df, _sparse(rb.column("_f"), None)[1], 1)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], names=["feature", "df"])

    counts = rows.mapInArrow(count, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()  # FEATURES rows at most
    idf = np.zeros(FEATURES)
    for r in counts:
        idf[r.feature] = np.log((1 + n) / r.df)
    basis = _range(rows, idf, width + EXTRA, seed, None)
    for _ in range(sharpen):
        basis = _range(rows, idf, width + EXTRA, seed, basis)
    gram = sum((np.frombuffer(r.data).reshape(basis.shape[1], -1) for r in rows.mapInArrow(_gram(idf, basis), "data binary").collect()),  # one small matrix per task
               np.zeros((basis.shape[1], basis.shape[1])))
    explained, turn = np.linalg.eigh(gram)
    order = np.argsort(-explained)[:width]
    axes = basis @ turn[:, order] * (explained[order] > 1e-9 * max(explained.max(initial=0), 1e-300))
    path = path or work_dir(spark, "latent")
    table = [(r.feature, float(idf[r.feature]), axes[r.feature].tolist()) for r in counts]
    spark.createDataFrame(table, "feature int, idf double, axes array<double>").write.parquet(os.path.join(path, "features"))
    return LatentModel(path, width)


def with_vector(df: DataFrame, text_col: str, model: LatentModel, out: str = "embedding") -> DataFrame:
    """``df`` with ``out``, the text's latent vector of length 1 (zero for a text whose
    terms the corpus doesn't have).  Row-local."""
    spark, keep = df.sparkSession, df.columns
    sent = spark.sparkContext.broadcast(model.load(spark))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            idf, basis = sent.value
            z = _times(*_sparse(rb.column("_f"), idf), basis, rb.num_rows)
            length = np.sqrt((z * z).sum(axis=1, keepdims=True))
            z /= np.where(length > 1e-12, length, 1)
            z[length[:, 0] <= 1e-12] = 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rb.num_rows + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), lists], names=[*keep, out])

    return _features(df, [df[c] for c in keep], text_col).mapInArrow(run, schema)
