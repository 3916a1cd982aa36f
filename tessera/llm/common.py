"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import work_dir

#: Characters that separate words: space and U+0009..U+000D.
SPACES = " \t\n\x0b\f\r"


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named input columns, under internal names, so that other
    columns of the input can neither clash nor be carried along."""
    return df.select(*[df[c].alias(name) for name, c in cols.items()])


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique long ``rid``, written to the shared folder: the ids
    must stay the same when a lost executor's tasks run again."""
    path = work_dir(df.sparkSession, name)
    df.withColumn("rid", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``: an
    expression bound as a lambda variable isn't evaluated again per use."""
    return F.transform(F.array(value), body)[0]


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as no bytes."""
    if column.null_count:
        column = column.fill_null("")
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def batches(schema: pa.Schema, rows: dict[str, list | np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, type=f.type)
         for f, x in zip(schema, (rows[f.name] for f in schema), strict=True)], schema=schema)
