"""Ranked lexical search by one scan of the texts for all terms of the items.

The terms of all items form one Aho-Corasick automaton.  A text is brought to one
form first: bytes that belong to no term become blanks, A-Z become small, a blank
stands before and after; the automaton holds every term between two blanks, so it
finds whole terms only, each place once.  What it gives at a match is the number
of the term, which maps to the items that hold it.  No index of the documents is
made: one scan counts them, their terms and the documents of every item term, a
second one scores and keeps the best documents per item and task.

Items are taken in blocks of a bounded number of terms; a block's automaton and
item lists go to every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import byte_texts, pick, ranges, with_row_ids
from tessera.session import materialize

#: Of a block of items, about: (item, term) pairs, and rows that it returns.
PAIRS, RETURNED = 1 << 17, 1 << 18
#: Scores held at once in a task; rows kept beside the running best until they are merged, as a multiple of it.
CELLS, SLACK = 1 << 20, 3

#: What a byte of a text becomes: bytes of terms stay (A-Z small), all others are blanks.
_FORM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def formed(text: bytes) -> bytes:
    return text.translate(_FORM)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return formed(text).split()


class Lexicon:
    """The terms of a block of items as an automaton, and the items of each term."""

    def __init__(self, items: list[list[bytes]]):
        found: dict[bytes, list[int]] = {}
        for i, words in enumerate(items):
            for w in dict.fromkeys(words):
                found.setdefault(w, []).append(i)
        self.words, self.items = list(found), len(items)
        sizes = np.fromiter(map(len, found.values()), np.int64, len(found))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.of = np.fromiter((i for part in found.values() for i in part), np.int64, int(sizes.sum()))
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}  # built where it is used

    def counts(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of terms of a text, numbers of the items' terms in it, how often each."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for no, word in enumerate(self.words):
                self.automaton.add_word(f" {word.decode('latin-1')} ", no)
            if self.words:
                self.automaton.make_automaton()
        form = formed(text)
        n = len(form.split())
        if not n or not self.words:
            return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = Counter(map(itemgetter(1), self.automaton.iter(f" {form.decode('latin-1')} ")))
        return n, np.fromiter(seen.keys(), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))


def _statistics(texts: DataFrame, lexicon) -> DataFrame:
    """(no, n) per task: documents that hold term ``no``; at -1 documents with a term, at -2 all their terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, df, docs, size = lexicon.value, np.zeros(len(lexicon.value.words), np.int64), 0, 0
        for b in it:
            for text in byte_texts(b.column(0)):
                n, no, _ = words.counts(text)
                df[no] += 1
                docs, size = docs + (n > 0), size + n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([df[held], [docs, size]]))], names=["no", "n"])

    return texts.mapInArrow(run, "no long, n long")


class Best:
    """The ``k`` best rows of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.items, self.least = k, items, np.ones(items, np.int64)
        self.held, self.size = [np.zeros((4, 0), np.int64)], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores``: (rows, items)."""
        row, item = np.nonzero(scores >= self.least)
        self.held.append(np.stack([item, scores[row, item], null[row], ids[row]]))
        self.size += len(row)
        if self.size > (SLACK + 1) * self.k * self.items:
            self.rows()

    def rows(self) -> np.ndarray:
        """(item, score, null, id) of the best, as rows of a matrix."""
        rows = np.concatenate(self.held, axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        n = np.bincount(rows[0], minlength=self.items)
        place = ranges(n)
        last = rows[:, place == self.k - 1]
        self.least[last[0]] = last[1]
        rows = rows[:, place < self.k]
        self.held, self.size = [rows], rows.shape[1]
        return rows


def _best(rows: DataFrame, lexicon, weights, docs: int, size: int, k: int) -> DataFrame:
    """(item, score, null, id): per task the ``k`` best of each item.  ``rows``: (id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = lexicon.value, weights.value
        best, step = Best(words.items, k), max(1, CELLS // max(1, words.items))
        for b in it:
            texts = byte_texts(b.column(1))
            null = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low in range(0, len(texts), step):
                part = texts[low:low + step]
                scores = np.zeros((len(part), words.items), np.int64)
                for i, text in enumerate(part):
                    n, no, tf = words.counts(text)
                    no, tf = no[w[no] > 0], tf[w[no] > 0]
                    if len(no):
                        m = 50 + 50 * n * docs // size
                        gain = w[no] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                        many = words.first[no + 1] - words.first[no]
                        np.add.at(scores[i], words.of[np.repeat(words.first[no], many) + ranges(many)], np.repeat(gain, many))
                best.add(scores, ids[low:low + step], null[low:low + step])
        rows = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["item", "score", "null", "id"])

    return rows.mapInArrow(run, "item long, score long, null long, id long")


def _blocks(items: DataFrame, k: int) -> list[Column]:
    """Conditions on ``rid`` that cut the items into blocks."""
    words = F.regexp_count("text", F.lit(r"[^\x00-/:-@\[-`{-\x7F]+"))
    rows, pairs = items.agg(F.count("*"), F.coalesce(F.sum(words), F.lit(0))).first()
    blocks = max(-(-pairs // PAIRS), -(-rows * k // RETURNED))
    return [F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b for b in range(blocks)]


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``items``.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) with N documents that
    have a term and df that hold it; a document of n terms has m = 50 + (50 n N div L),
    L terms in all; an item's score sums weight * (10^9 tf div (1000 tf + 20 m)) over
    its distinct terms.  Only scores above 0 count; ties go to the smaller ``doc_id``,
    null ids come last.

    Null and empty texts have no term; repeated documents and items are rows of
    their own; an empty table on either side gives no rows.  Other columns aren't
    read.  The terms of one item must fit a task; the documents of a term may be any
    number.  N, L and the weights are those of all documents, in every block."""
    spark = docs.sparkSession
    texts = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    asked = with_row_ids(pick(items, item_id=item_col, text=item_text_col), "items")
    kind = items.schema[item_col].dataType
    found = None
    for block in _blocks(asked, k):
        rows = asked.where(block).select("rid", "text").collect()  # bounded by PAIRS
        rids = [r.rid for r in rows]
        lexicon = Lexicon([terms((r.text or "").encode()) for r in rows])
        if not lexicon.words:
            continue
        sent = spark.sparkContext.broadcast(lexicon)
        counts = dict(map(tuple, _statistics(texts.select("text"), sent).groupBy("no").agg(F.sum("n")).collect()))  # a row per term of the block
        total, size = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * counts.get(no, 0) + 1))) for no in range(len(lexicon.words))], np.int64)
        best = _best(texts, sent, spark.sparkContext.broadcast(weights), total, max(1, size), k)
        names = spark.createDataFrame(list(enumerate(rids)), "item long, rid long")
        best = best.join(F.broadcast(names), "item").select("rid", "score", "null", "id")  # a row per item of the block
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long")
    place = Window.partitionBy("rid").orderBy(F.desc("score"), "null", "id")
    top = materialize(found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "item-best")
    doc_id = F.when(F.col("null") == 0, F.col("id")).cast(docs.schema[id_col].dataType)
    return top.join(asked.select("rid", "item_id"), "rid").select("item_id", "rank", doc_id.alias("doc_id"), "score")
