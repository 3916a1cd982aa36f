"""License scan: fuzzy search for short notices.

A notice of ``L`` characters with at most ``k`` edits is cut into ``k + 1``
pieces; by the pigeonhole principle at least one piece of every occurrence is
unchanged.  The pieces are searched exactly (these are the seeds), and around
each seed the ``regex`` library's bounded-error matching verifies the edits and
gives the span.  Everything is row-local: no shuffle, and a task holds one
Arrow batch of texts.

Texts are compared as words: A-Z lower-cased, words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, pick

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_CLEAN = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """``words`` as they stand in a normalised text; ``edits`` is the most
    insertions, deletions and substitutions of characters that still match."""

    words: str
    label: str
    edits: int
    base: bool = False
    seeds: tuple[tuple[bytes, int], ...] = field(default=(), compare=False)

    def __post_init__(self):
        raw, n = self.words.encode(), self.edits + 1
        cuts = [len(raw) * i // n for i in range(n + 1)]
        object.__setattr__(self, "seeds", tuple((raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)))

    @cached_property
    def pattern(self):
        return regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(self.words)}){{e<={self.edits}}}(?![^ ])")


#: The three base phrases, whose exact places are counted, and longer notices with labels of their own.
NOTICES = (
    Notice("mit license", "mit", 1, True),
    Notice("apache license", "apache", 1, True),
    Notice("general public license", "gpl", 2, True),
    Notice("released under the mit license", "mit-notice", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit-text", 6),
    Notice("licensed under the apache license version 2 0", "apache-2.0", 4),
    Notice("licensed under the gnu general public license version 3", "gpl-3.0", 4),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("licensed under cc by nc 4 0", "cc-by-nc-4.0", 2),
)


def normalise(text: bytes) -> tuple[bytes, int]:
    """The words joined (and enclosed) by one space, and their number."""
    words = text.translate(_CLEAN).split()
    return b" " + b" ".join(words) + b" ", len(words)


def find_all(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def spans_of(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of every place of the notice in a normalised text.

    All exact places are given, overlapping ones too; a place with edits is
    given unless it overlaps an exact one or a better one before it.
    """
    raw, k = notice.words.encode(), notice.edits
    size, exact, loose = len(raw), set(), set()
    for seed, offset in notice.seeds:
        for at in find_all(text, seed):
            start = at - offset
            if start > 0 and text[start - 1:start + size + 1] == b" " + raw + b" ":
                exact.add(start)
            else:
                loose.add(start)
    found = [(s, s + size, 0) for s in sorted(exact)]
    last = -1  # end of the latest window that was searched
    fuzzy: list[tuple[int, int, int]] = []
    for start in sorted(loose):
        if start + size // 2 <= last:
            continue
        # whole words around the place, so that the window decodes as UTF-8
        a = text.rfind(b" ", 0, max(1, start - k)) + 1
        b = text.find(b" ", min(len(text) - 1, start + size + 2 * k))
        window = text[a:b]
        for m in notice.pattern.finditer(window.decode()):
            edits = sum(m.fuzzy_counts)
            s = a + len(window.decode()[:m.start()].encode())
            e = s + len(m.group().encode())
            if edits and not any(x < e and s < y for x, y, _ in found) and not any(x < e and s < y for x, y, _ in fuzzy):
                fuzzy.append((s, e, edits))
                last = max(last, e)
    return sorted(found + fuzzy)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per row of ``df``: its id, ``n_words`` and ``spans``, an array of
    (label, phrase, base, start_word, end_word, edits, matched).

    A null text is an empty one (no words, no spans); a null id and repeated
    rows are kept as they are, row by row; an empty table gives no rows; other
    columns are not read.  ``end_word`` is the last word of the place.
    """
    span = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_()), ("start_word", pa.int64()),
                      ("end_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, out = [], []
            for raw in byte_texts(batch.column(1)):
                text, n = normalise(raw)
                counts.append(n)
                out.append([{"label": x.label, "phrase": x.words, "base": x.base, "start_word": text.count(b" ", 0, s) - 1,
                             "end_word": text.count(b" ", 0, e) - 1, "edits": d, "matched": text[s:e].decode()}
                            for x in notices for s, e, d in spans_of(text, x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.list_(span))],
                                             names=["id", "n_words", "spans"])

    rows = pick(df, id=id_col, text=text_col)
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n_words long, spans array<struct<label:string,phrase:string,"
              "base:boolean,start_word:long,end_word:long,edits:int,matched:string>>")
    return rows.mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query from the spans of :func:`scan`."""
    exact = F.filter("spans", lambda s: s["base"] & (s["edits"] == 0))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(exact, lambda s: s["start_word"])
    return scanned.select(
        F.col("id").alias("doc_id"), "n_words", F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(exact).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["phrase"]))), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_places"))
