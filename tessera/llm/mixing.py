"""Mixing sources to target weights, with DataFrame functions only.

Targets: the sources share ``epochs`` times all words by weight; a source stops
at ``most`` times its words and the excess goes to the others by weight, until
none is above (water filling over one row per source).

Copies: every document of a source is expected target / size times.  Systematic
sampling adds one random offset per source to the prefix sums of these
expectations and emits a document once per integer crossed.  The prefix sum at a
document is its place among its source's documents times their common
expectation.  Places come from counts per (source, size class, salt) and a rank
within each such cell, so no window holds a whole source.  Within a source the
documents go by size class, so every stretch of sizes gives its share and the
words taken stay near the target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACES, pick, with_row_ids
from tessera.session import materialize

#: Offsets are multiples of this part.
GRAIN = 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), epochs: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) with weight and target.  Weights go to the sources
    by code point, null last, in turn.  One row per source in and out."""
    alone = Window.partitionBy(F.lit(0))
    cap, ratio = most * F.col("source_size"), F.col("cap") / F.col("weight")
    turn = F.row_number().over(alone.orderBy(F.col("source").isNull(), "source")) - 1
    w = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights)))).cast("long"))
    w = w.withColumn("cap", cap).withColumn("ratio", ratio)
    # by rising cap per weight, the first sources are at their cap; then all others are under theirs
    up = alone.orderBy("ratio", F.col("source").isNull(), "source")
    left = F.lit(epochs) * F.sum("source_size").over(alone) - (F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    weight = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", left / weight).withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(alone)
    return w.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level["level"])) \
        .select("source", "source_size", "weight", "target")


def _copies(docs: DataFrame, weights: tuple[int, ...], epochs: float, most: int, seed: str) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with size, source_size,
    target, copies and taken in the text's place."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), f"[{SPACES}]+"), lambda w: w != "")).cast("long")
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    rows = materialize(docs.select(*others, "doc_id", "source", words.alias("size"), salt.alias("salt")), "mix-sizes")
    rows = rows.withColumn("salt", F.pmod("salt", F.lit(256))).withColumn("class", F.floor(8 * F.log2(F.col("size") + 1)))
    cells = materialize(rows.groupBy("source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells")
    aim = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs, most)
    # two steps, so that a window holds the classes of a source or the salts of a class at most
    by_class = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    by_class = by_class.select("source", "class", (F.sum("n").over(Window.partitionBy("source").orderBy("class")) - F.col("n")).alias("lower"))
    inner = F.sum("n").over(Window.partitionBy("source", "class").orderBy("salt")) - F.col("n")
    cells = cells.withColumn("inner", inner)
    cells = cells.join(by_class, _same(cells, by_class, "class")).select(cells["source"], cells["class"], "salt", (F.col("inner") + F.col("lower")).alias("before"))
    cells = cells.join(aim, _same(cells, aim)).select(cells["source"], cells["class"], "salt", "before", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy("size", "doc_id"))
    rows = rows.withColumn("place", place)
    rows = rows.join(cells, _same(rows, cells, "class", "salt")).select(
        *others, rows["doc_id"], rows["source"], "size", "source_size", "target", (F.col("before") + F.col("place")).alias("place"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("\0")))), 1, 8), 16, 10).cast("long")
    offset = F.pmod(draw, F.lit(GRAIN)) / GRAIN
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(F.col("place") * each + offset) - F.floor((F.col("place") - 1) * each + offset)
    return rows.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).withColumn("taken", F.col("copies") * F.col("size")) \
        .select(*others, "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), epochs: float = 1.5, most: int = 2, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``df``: doc_id, source, size, source_size, target, copies, taken.

    A null text has no words; a null source is a source of its own, the last;
    repeated rows are documents of their own (equal ones may change places, so
    their ``copies`` may, but not their number); null ids come first; a source
    without words has target 0 and takes none; an empty table gives no rows."""
    return _copies(pick(df, doc_id=id_col, text=text_col, source=source_col), weights, epochs, most, seed)


def mixed(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), epochs: float = 1.5, most: int = 2, seed: str = "mix",
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as :func:`mix` takes it (0 to ``most``
    times), with all their columns; the cases are those of :func:`mix`."""
    rows = with_row_ids(df.select(F.struct(*[df[c] for c in df.columns]).alias("row")), "mix-rows")
    docs = rows.select("rid", *[F.col("row")[c].alias(n) for n, c in (("doc_id", id_col), ("text", text_col), ("source", source_col))])
    times = _copies(docs, weights, epochs, most, seed).where("copies > 0").select("rid", "copies")
    return rows.join(times, "rid").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Join condition in which null sources are equal."""
    return reduce(Column.__and__, [a[k] == b[k] for k in keys], a["source"].eqNullSafe(b["source"]))
