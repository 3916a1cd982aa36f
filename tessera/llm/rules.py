"""Quality rules as a short-circuit cascade, with DataFrame functions only.

``word_counts`` computes the base figures row by row inside the JVM (no
explode, no shuffle).  ``cascade`` orders rules that reject documents by
rejections per cost, both measured on a sample, and evaluates them in that
order in one ``CASE WHEN``, which stops at the first rule that rejects.  The
order changes the time and which rule is named, never which documents stay.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, let, pick
from tessera.session import materialize

#: Rows at which rules are timed and counted (about; a bound by expectation), a parameter of :func:`cascade`.
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects``: a boolean column; null counts as false."""

    name: str
    rejects: Column


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window that occurs twice or more.

    Windows are compared by their 64-bit hash, sorted with their place, so the
    cost is n log n for a text of any length."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
    starts = let(F.array_sort(windows), lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
    covered = let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(words) < 3, 0).otherwise(covered)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (which has no columns of these names) with n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines; a null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACES) != "")
    figures = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return df.withColumn("_w", figures).withColumn("_l", by_line).withColumns({
        "n_words": F.col("_w.n_words").cast("long"), "word_chars": F.length(_without(t, SPACES)).cast("long"),
        "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"), "n_dup_lines": F.col("_l.n_dup_lines").cast("long"),
        "n_repeat_words": F.col("_w.n_repeat_words").cast("long"), "n_lines": F.col("_l.n_lines").cast("long")}).drop("_w", "_l")


#: The base rules, and those of the cascade besides.
def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict_rules(text: str = "text") -> list[Rule]:
    t = F.coalesce(F.col(text), F.lit(""))
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > chars),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("few_letters", 2 * F.length(F.regexp_replace(t, r"\P{L}", "")) < chars),
        Rule("shouting", 2 * F.length(F.regexp_replace(t, r"\P{Lu}", "")) > chars),
        Rule("long_words", chars > 60 * n),
        Rule("ellipsis_lines", 10 * F.size(F.split(t, r"(?:\.\.\.|…)(?:\n|\z)")) > 10 + 5 * F.col("n_lines")),
    ]


def cascade_order(df: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds on the sample) and share of rejections,
    in descending order of rejections per second."""
    rows = df.count()
    sample = df if rows <= sample_rows else df.sample(fraction=sample_rows / rows, seed=7)
    sample = materialize(sample, "rule-sample")
    sample.agg(F.count("*")).collect()
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected, n = sample.agg(F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long")), F.count("*")).first()
        found.append((rule, time.perf_counter() - began, (rejected or 0) / max(1, n)))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(df: DataFrame, rules: Sequence[Rule], sample_of: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with ``rejected_by``: the first rule that rejects the row, in the
    order found on a sample (of ``sample_of``, by default ``df``), else null."""
    first = F.lit(None).cast("string")
    for rule, _, _ in reversed(cascade_order(df if sample_of is None else sample_of, rules, sample_rows)):
        first = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(first)
    return df.withColumn("rejected_by", first)


def judged(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (with ``text``, and no column named like those that are added)
    with the base figures, base_failed, rejected_by and kept."""
    rows = docs.count()
    few = docs if rows <= sample_rows else docs.sample(fraction=sample_rows / rows, seed=7)
    sample = word_counts(materialize(few.select("text"), "rule-docs"))
    out = cascade(word_counts(docs), verdict_rules(), sample, sample_rows).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, the base figures, base_failed, rejected_by, kept.

    A null text has no words and fails the base; null and repeated ids are kept
    row by row; an empty table gives no rows; other columns aren't read."""
    return judged(pick(df, doc_id=id_col, text=text_col), sample_rows).drop("text")


def keep_good(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns.

    Columns are carried as one struct, so none can clash; null texts fail the
    base and go; repeated rows stay or go alike; an empty table stays empty."""
    docs = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text_col].alias("text"))
    # a filter on ``kept`` would be pushed below the figures and work them out once per use;
    # what a generator puts out can't be pushed
    some = F.array(F.struct(F.lit(True).alias("stays"), "row"))
    good = judged(docs, sample_rows).select(F.when(F.col("kept"), some).otherwise(F.slice(some, 1, 0)).alias("some"))
    return good.select(F.inline_outer("some")).where("stays").select("row.*")
