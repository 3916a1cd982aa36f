"""Shards that all match the mixture: proportional stratified interleaving.

Within a source, rows are shuffled by a seeded hash and ranked; a row's
fractional rank is (rank - offset) / rows of its source, with one offset in
(0, 1) per source, so sources of one row don't all fall in the middle.  Sorted by
fractional rank, every stretch of the table holds each source in proportion; cut
into stretches of equal length, these are the shards.  A shard's count of a
source differs from the even share by a few rows at most.

Ranks and the places in the sorted table are running counts over range
partitions (:func:`tessera.operators.scan.keyed_running`), so neither a source
with a third of the rows nor a hash that many rows share stays in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pick, with_row_ids
from tessera.operators.scan import keyed_running
from tessera.session import materialize

#: Sources whose counts (one row each) go to every task; with more, counts and rows meet by (source, salt).
SOURCES, SALTS = 50_000, 64


def _draw(*parts: Column) -> Column:
    """52 bits of a hash, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("long")


def _sizes(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``n``, the rows of their source."""
    if keys.limit(SOURCES + 1).count() <= SOURCES:
        return rows.join(F.broadcast(keys), "k")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["k", "salt"]).drop("salt")


def _places(rows: DataFrame, shards: int, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, rid, crc, ...) with shard and slot in the source's place."""
    k = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    none = F.lit("")
    h = _draw(F.lit(seed), F.coalesce(F.col("doc_id"), none), F.col("crc").cast("string"), F.col("size").cast("string"))
    rows = materialize(rows.withColumn("k", k).withColumn("h", h).drop("source"), "shard-rows")
    keys = materialize(rows.groupBy("k").agg(F.count("*").alias("n")), "shard-sources")
    total = keys.agg(F.sum("n")).first()[0] or 0
    ranked = _sizes(keyed_running(rows, "k", [F.col("h"), F.col("doc_id"), F.col("rid")], [("rank", "count", None)]), keys)
    offset = (_draw(F.lit(seed), F.lit("source"), F.col("k")) + 0.5) / float(1 << 52)
    ranked = ranked.withColumn("part", (F.col("rank") - offset) / F.col("n")).withColumn("all", F.lit(0))
    placed = keyed_running(ranked, "all", [F.col("part"), F.col("k"), F.col("rank")], [("place", "count", None)])
    n = max(1, total)
    shard = f"(place - 1) * {int(shards)}L div {n}L"
    first = f"({shard}) * {n}L + {int(shards) - 1}L"  # divided by the shards: the first place of the shard
    return placed.withColumn("shard", F.expr(shard).cast("int")).withColumn("slot", F.expr(f"place - 1 - ({first}) div {int(shards)}L")) \
        .drop("k", "h", "n", "rank", "part", "all", "place")


def _narrow(df: DataFrame, doc_id: Column, text: Column, source: Column) -> DataFrame:
    """(rid, doc_id, source, size, crc): what the places need of the rows of ``df``, which has ``rid``."""
    whole = F.coalesce(text, F.lit(""))
    # the id as text: it passes a scan in pandas, which has no null among whole numbers
    return df.select("rid", doc_id.cast("string").alias("doc_id"), source.cast("string").alias("source"),
                     (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"))


def shard(df: DataFrame, shards: int = 8, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law
    ``rows`` (the shards' counts are at most one apart), shard, slot (0, 1, ... in
    the shard), grown_shard (null: the law isn't ``key``).

    A null text is empty, a null source is a source of its own, rows that repeat
    are rows of their own (equal ones may change places), null ids count as the
    empty text in the hash; with fewer rows than shards some shards stay empty; an
    empty table gives no rows.  The method has no groups: equal texts may lie in
    different shards.  Other columns aren't read."""
    rows = pick(df, doc_id=id_col, text=text_col, source=source_col).withColumn("rid", F.monotonically_increasing_id())
    placed = _places(_narrow(rows, F.col("doc_id"), F.col("text"), F.col("source")), shards, seed)
    return placed.select(F.col("doc_id").cast(df.schema[id_col].dataType).alias("doc_id"), "size", F.col("crc").alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(df: DataFrame, path: str, shards: int = 8, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> None:
    """The rows of ``df`` with all their columns as Parquet in folders
    ``path/shard=0``, ``shard=1``, ...; files in the order of their names hold the
    shard's rows in the order of their slots (columns ``row`` and ``slot``)."""
    rows = with_row_ids(df.select(F.struct(*[df[c] for c in df.columns]).alias("row")), "shard-input")
    row = F.col("row")
    placed = _places(_narrow(rows, row[id_col], row[text_col], row[source_col]), shards, seed).select("rid", "shard", "slot")
    rows.join(placed, "rid").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
