"""Running (prefix) aggregates per key without putting a key in one task.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task;
a key holding a third of the data then runs on one core.  ``keyed_running``
computes the same inclusive running values in three steps:

1. ``repartitionByRange(key, order)``: Spark samples the sort keys, so a hot
   key's rows are spread over several consecutive partitions ("blocks").
2. One Arrow-batched pass per partition (``mapInPandas``) computes the
   running values inside the block, carrying state across batches; the
   result is written to the shared scratch folder (reliable, lineage cut).
3. Only the first and last key of each block can continue into another
   block.  Their block totals (at most 2 rows per block) get an exclusive
   running combine over blocks, and that carry table -- bounded by twice the
   number of partitions, so safe to broadcast -- is joined back.

Supported kinds: ``count`` (rows so far), ``sum``, ``max`` and ``last``
(last non-null value so far, i.e. forward fill).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

KINDS = ("count", "sum", "max", "last")


def _local_scan(key: str, specs: list[tuple[str, str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        blk = TaskContext.get().partitionId()
        carry_key, carry = None, {}
        pos0 = 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[key]
            grp = (keys != keys.shift()).cumsum()
            first = grp == grp.iloc[0]
            same = carry_key is not None and keys.iloc[0] == carry_key
            for out, kind, src in specs:
                if kind == "count":
                    v = grp.groupby(grp).cumcount().astype("int64") + 1
                    if same:
                        v = v.where(~first, v + carry[out])
                elif kind == "sum":
                    v = pdf[src].fillna(0).groupby(grp).cumsum()
                    if same:
                        v = v.where(~first, v + carry[out])
                elif kind == "max":
                    v = pdf[src].groupby(grp).cummax()
                    v = v.groupby(grp).ffill()
                    if same and carry[out] is not None and not pd.isna(carry[out]):
                        v = v.where(~first, v.where(v >= carry[out], carry[out]).fillna(carry[out]))
                else:  # last
                    v = pdf[src].groupby(grp).ffill()
                    if same and carry[out] is not None:
                        v = v.where(~first | v.notna(), carry[out])
                pdf[out] = v
            pdf["_blk"] = blk
            pdf["_pos"] = range(pos0, pos0 + len(pdf))
            pos0 += len(pdf)
            carry_key = keys.iloc[-1]
            carry = {out: pdf[out].iloc[-1] for out, _, _ in specs}
            yield pdf

    return run


def keyed_running(df: DataFrame, key: str, order: list, aggs: list[tuple[str, str, Column | str | None]],
                  partitions: int | None = None) -> DataFrame:
    """Add inclusive running aggregates per ``key`` in ``order``.

    ``aggs`` is a list of ``(out_name, kind, column)``; ``column`` is ignored
    for ``count``.  ``order`` must make rows of a key totally ordered.
    Output keeps all input columns plus the outputs.
    """
    specs = []
    base = df
    for i, (out, kind, col) in enumerate(aggs):
        if kind not in KINDS:
            raise ValueError(f"unknown running kind {kind!r}")
        src = None
        if kind != "count":
            src = f"_src{i}"
            base = base.withColumn(src, F.col(col) if isinstance(col, str) else col)
        specs.append((out, kind, src))

    fields = list(base.schema.fields)
    for out, kind, src in specs:
        if kind == "count":
            fields.append(T.StructField(out, T.LongType()))
        else:
            fields.append(T.StructField(out, base.schema[src].dataType))
    fields += [T.StructField("_blk", T.IntegerType()), T.StructField("_pos", T.LongType())]
    schema = T.StructType(fields)

    # Without an explicit count AQE may coalesce adjacent range partitions
    # (order is kept) so small inputs do not start one Python task per
    # shuffle partition; large inputs get spark.sql.shuffle.partitions.
    ranged = (base.repartitionByRange(partitions, F.col(key), *order) if partitions
              else base.repartitionByRange(F.col(key), *order))
    ordered = ranged.sortWithinPartitions(F.col(key), *order)
    local = materialize(ordered.mapInPandas(_local_scan(key, specs), schema), "scan")

    ends = local.groupBy("_blk").agg(F.min(key).alias("_k1"), F.max(key).alias("_k2"))
    edge_keys = (
        ends.select("_blk", F.col("_k1").alias(key))
        .union(ends.select("_blk", F.col("_k2").alias(key)))
        .distinct()
    )
    outs = [o for o, _, _ in specs]
    totals = (
        local.join(F.broadcast(edge_keys), [key, "_blk"])
        .groupBy(key, "_blk")
        .agg(F.max_by(F.struct(*outs), F.col("_pos")).alias("_t"))
        .select(key, "_blk", *[F.col("_t")[o].alias(o) for o in outs])
    )
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for out, kind, _ in specs:
        if kind in ("count", "sum"):
            c = F.sum(out).over(before)
        elif kind == "max":
            c = F.max(out).over(before)
        else:
            c = F.last(out, ignorenulls=True).over(before)
        carry_cols.append(c.alias(f"_c_{out}"))
    carry = totals.select(key, "_blk", F.count(F.lit(1)).over(before).alias("_prev"), *carry_cols).where(
        "_prev > 0"
    ).drop("_prev")

    joined = local.join(F.broadcast(carry), [key, "_blk"], "left")
    final = []
    for out, kind, _ in specs:
        c = F.col(f"_c_{out}")
        if kind in ("count", "sum"):
            final.append((F.col(out) + F.coalesce(c, F.lit(0))).alias(out))
        elif kind == "max":
            final.append(F.greatest(F.col(out), c).alias(out))
        else:
            final.append(F.coalesce(F.col(out), c).alias(out))
    keep = [c for c in df.columns]
    return joined.select(*keep, *final)
