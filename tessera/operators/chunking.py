"""Chunking generators: one row in, many rows out (C1, C3, C4) and the
per-file row packer (C2).

C1 and C3/C4 are row-local: an ``aggregate`` / ``sequence`` over one row's
words or length, then ``posexplode``.  No shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words as split_words

# Operating sizes.
TEXT_CHUNK_CHARS = 1000
TABLE_CHUNK_TOKENS = 1000
PAGE_SLICE_CHARS = 4000


def _starts_by_fold(sizes: Column, limit: int, add_blank: bool, inclusive: bool) -> Column:
    """1-based positions where a new chunk starts (after the first one).

    Greedy rule: ``cur + size (+1) > limit`` (or ``>=`` when ``inclusive``)
    closes the current chunk before the element.  State holds integers only,
    never the growing text.
    """
    extra = 1 if add_blank else 0

    def step(a, n):
        t = a["cur"] + n + F.lit(extra)
        cut = (t >= limit) if inclusive else (t > limit)
        return F.struct(
            F.when(cut, n).otherwise(t).alias("cur"),
            (a["i"] + 1).alias("i"),
            F.when(cut, F.array_append(a["starts"], a["i"])).otherwise(a["starts"]).alias("starts"),
        )

    init = F.struct(
        F.lit(0).cast("bigint").alias("cur"),
        F.lit(1).alias("i"),
        F.array().cast("array<int>").alias("starts"),
    )
    return F.aggregate(sizes, init, step, lambda a: a["starts"])


def _pieces(items: Column, starts: Column, joiner: str) -> Column:
    """Join ``items`` between consecutive starts; first chunk starts at 1."""
    bounds = F.concat(F.array(F.lit(1)), starts)
    return F.transform(
        bounds,
        lambda s, k: F.array_join(
            F.slice(items, s, F.coalesce(F.get(starts, k), F.size(items) + 1) - s), joiner
        ),
    )


def word_chunks(df: DataFrame, text_col: str, limit: int = TEXT_CHUNK_CHARS, keep: list | None = None,
                out: str = "chunk") -> DataFrame:
    """Greedy word chunks of at most ``limit`` characters; rows
    ``(*keep, chunk_no, out)`` with ``chunk_no`` from 0.

    A word longer than the limit is a chunk of its own; the empty chunk the
    rule produces before an over-long first word is dropped (D3).  Three
    projections: words, chunk starts (integer fold), chunk texts.
    """
    keep = keep or []
    ws = df.select(*keep, split_words(F.col(text_col)).alias("_ws"))
    st = ws.select(
        *keep, "_ws",
        _starts_by_fold(F.transform("_ws", lambda w: F.length(w).cast("bigint")), limit, True, False).alias("_st"),
    )
    pieces = F.filter(_pieces(F.col("_ws"), F.col("_st"), " "), lambda c: c != "")
    return st.select(*keep, F.posexplode(pieces).alias("chunk_no", out))


def chunk_words(df: DataFrame, id_col: str, text_col: str, limit: int = TEXT_CHUNK_CHARS,
                out: str = "chunk") -> DataFrame:
    """``(id, chunk_no, chunk)`` rows; ``chunk_no`` from 0."""
    return word_chunks(df, text_col, limit, [id_col], out)


def chunk_fixed(df: DataFrame, id_col: str, text_col: str, width: int = PAGE_SLICE_CHARS,
                out: str = "slice") -> DataFrame:
    """Consecutive slices of ``width`` characters; empty text gives none."""
    t = F.col(text_col)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(width))).otherwise(
        F.array().cast("array<int>")
    )
    slices = F.transform(starts, lambda s: F.substring(t, s + 1, width))
    return df.select(F.col(id_col), F.posexplode(slices).alias("slice_no", out))


def even_split(df: DataFrame, id_col: str, size_col: str, limit: int) -> DataFrame:
    """C4: ``ceil(size/limit)`` parts of ``ceil(size/n)`` units, last shorter;
    sizes at or under the limit are one part.  ``(id, part_no, start, end)``.
    """
    size = F.col(size_col).cast("bigint")
    n = F.when(size > limit, F.ceil(size / F.lit(limit))).otherwise(F.lit(1)).cast("bigint")
    part = F.ceil(size / n).cast("bigint")
    return (
        df.select(F.col(id_col), size.alias("_size"), n.alias("_n"), part.alias("_part"))
        .select(
            F.col(id_col), "_size", "_part",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("part_no"),
        )
        .select(
            F.col(id_col),
            F.col("part_no"),
            (F.col("part_no") * F.col("_part")).alias("start"),
            F.least((F.col("part_no") + 1) * F.col("_part"), F.col("_size")).alias("end"),
        )
    )


def pack_table_rows(rows: DataFrame, name_of, limit: int = TABLE_CHUNK_TOKENS, order: str = "row_no",
                    partitions: int | None = None) -> DataFrame:
    """``rows(file, <order>, row)`` to ``(file, chunk_no, chunk)``; each
    chunk is ``name + "\\n\\n" + rows`` and has at least one row.

    ``order`` names a sortable column (a number or a struct of the order
    columns) that puts the header first and is unique within a file.
    ``name_of(file_col) -> Column`` gives the file name.  One way for files of
    all sizes (:mod:`tessera.operators.row_packing`).
    """
    from tessera.functions.text import token_count
    from tessera.operators.row_packing import pack

    tok = rows.select("file", F.col(order).alias("ord"), "row", token_count(F.col("row")).alias("n"))
    return pack(tok, limit, partitions).select("file", "chunk_no", F.concat(name_of(F.col("file")), F.lit("\n\n"), F.col("body")).alias("chunk"))
