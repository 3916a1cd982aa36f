"""Sentence boundaries learned from the corpus.

Whether a period ends a sentence is decided by what the corpus shows, without
labels, after Kiss & Strunk (2006):

1. Counts per word type: with and without a final period, small and, inside of a
   sentence, capitalised.  Ordinary aggregates with partial combine.
2. A type is an abbreviation if a likelihood ratio says that it nearly always has
   its period, weighted for short types and inner periods and against types that
   often lack it (``ABBREVIATION``).
3. Words that follow sure ends unusually often are sentence starters (``STARTER``);
   an abbreviation, initial or number and its next word that come together unusually
   often are a collocation (``COLLOCATION``).
4. A period ends a sentence unless its word is part of a collocation, or is an
   abbreviation, initial or number before a small letter; after an abbreviation or
   initial it does only before a starter, or before a capitalised word that is
   small inside of sentences.  ``!`` and ``?`` end a sentence, dots of omission do
   before a capital.

The tables of step 2 and 3 grow with the vocabulary, so candidates meet them in
joins on the word (which Spark broadcasts while they are small); a document's ends
come back as one array.  Decimals and other inner periods are no candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: A word with the white space before it; what isn't part of a word before and behind it; what ends it.
PIECE, BEFORE, BEHIND, MARKS = r"\s*\S+", r"^[^\p{L}\p{N}]+", r"[\"'”’»)\]]+$", r"[.,;:!?…]+$"
NUMBER = r"^[0-9][0-9.,]*$"
#: A word of small letters alone (to the very end: ``$`` also stands before a last line separator).
SMALL = r"^ *\p{Ll}+\z"
#: How a word begins that begins with a capital.
CAPITAL = r"^[^\p{L}\p{N}]*\p{Lu}"


def pieces(text: Column) -> Column:
    """The words of a text, each with the white space before it; line ends are blanks."""
    return F.regexp_extract_all(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(PIECE), 0)


def word(piece: Column) -> Column:
    """(type, mark, case) of a word: ``type`` small, without edges, ``#`` for numbers;
    ``mark`` p: period, l: several, e: ``!`` or ``?``; ``case`` u, l or nothing.

    A word of small letters, as most are, is its own type; for others each step is an
    array of one, as an expression that is named twice in a lambda is worked out twice."""
    core = F.transform(F.array(piece), lambda x: F.regexp_replace(F.ltrim(x), BEFORE, ""))
    body = F.transform(core, lambda x: F.struct(x.alias("core"), F.regexp_replace(x, BEHIND, "").alias("body")))
    plain = F.transform(body, lambda x: F.struct(x["core"].alias("core"), x["body"].alias("body"), F.lower(F.regexp_replace(x["body"], MARKS, "")).alias("plain")))

    def parts(x: Column) -> Column:
        core, body, plain = x["core"], x["body"], x["plain"]
        mark = F.when(body.rlike(r"[!?]$"), "e").when(body.rlike(r"(\.\.|…)$"), "l").when(body.endswith("."), "p").otherwise("")
        case = F.when(core.rlike(r"^\p{Lu}"), "u").when(core.rlike(r"^\p{Ll}"), "l").otherwise("")
        return F.struct(F.when(plain.rlike(NUMBER), "#").otherwise(plain).alias("type"), mark.alias("mark"), case.alias("case"))

    small = F.struct(F.ltrim(piece).alias("type"), F.lit("").alias("mark"), F.lit("l").alias("case"))
    return F.when(piece.rlike(SMALL), small).otherwise(F.get(F.transform(plain, parts), 0))


@dataclass(frozen=True)
class Model:
    """What a corpus tells: ``counts(type, n, n_dot, lower, inner)``, ``abbreviations(type,
    n_dot, n_plain, score)``, ``starters(type)``, ``collocations(type, next)``."""

    counts: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def _marked(piece: Column) -> Column:
    """Whether a word holds what a mark is made of.  Every word is asked, so by bytes, not by patterns."""
    return F.contains(piece, F.lit(".")) | F.contains(piece, F.lit("!")) | F.contains(piece, F.lit("?")) | F.contains(piece, F.lit("…"))


def _capital(piece: Column) -> Column:
    """Whether a word begins with a capital; the pattern is for words that are not of small ASCII letters."""
    return ((F.lower(piece) != piece) | (F.octet_length(piece) > F.length(piece))) & piece.rlike(CAPITAL)


@dataclass(frozen=True)
class Words:
    """What all passes read, written once: ``texts(id, p)``, the pieces of each document,
    and ``marked(id, i, type, mark, next, next_case)``, its words with a mark and a word after them."""

    texts: DataFrame
    marked: DataFrame


def _words(docs: DataFrame, id_col: str, text_col: str) -> Words:
    texts = materialize(docs.select(F.col(id_col).alias("id"), pieces(F.coalesce(F.col(text_col), F.lit(""))).alias("p")), "sentence-words")
    # few pieces hold a character that makes a mark: only these and their next ones are looked into
    rows = _pick(texts, 0, F.size("p") - 2, lambda i: _marked(F.get("p", i)), lambda i: (F.get("p", i).alias("p"), F.get("p", i + 1).alias("q")))
    rows = rows.select("id", "i", word(F.col("p")).alias("w"), word(F.col("q")).alias("v"))
    rows = rows.select("id", "i", "w.type", "w.mark", F.col("v.type").alias("next"), F.col("v.case").alias("next_case"))
    return Words(texts, materialize(rows, "sentence-marks").where(F.col("mark") != ""))  # here: before it, ``word`` would run twice


def _pick(texts: DataFrame, first: int, last: Column, wanted, fields) -> DataFrame:
    """(id, i, fields): a row per place of ``first`` to ``last`` that is wanted; other
    places don't leave their document's array."""
    places = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(F.filter(places, wanted), lambda i: F.struct(i.alias("i"), *fields(i)))
    return texts.select("id", F.explode(rows).alias("x")).select("id", "x.*")


def _counts(texts: DataFrame) -> DataFrame:
    """(type, n, n_dot, lower, inner).  Pieces are counted as written, then what was
    found is looked into, once each: a vocabulary, not every word."""
    known = texts.select(F.explode("p").alias("p")).groupBy(F.ltrim("p").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    known = known.select("n", word(F.col("p")).alias("w")).select("w.*", "n")
    if_ = lambda c: F.when(c, F.col("n")).otherwise(0)
    known = known.select("type", "n", if_(F.col("mark") == "p").alias("n_dot"), if_(F.col("case") == "l").alias("lower"), F.lit(0).cast("bigint").alias("inner"))
    # a capital inside of a sentence: behind a word without a mark
    pair = _pick(texts, 1, F.size("p") - 1, lambda i: _capital(F.get("p", i)), lambda i: (
        F.ltrim(F.get("p", i)).alias("p"), F.when(_marked(F.get("p", i - 1)), F.get("p", i - 1)).alias("before")))
    pair = pair.groupBy("p", "before").agg(F.count(F.lit(1)).alias("n"))
    pair = pair.where(F.col("before").isNull() | (word(F.col("before"))["mark"] == "")).select(word(F.col("p")).alias("w"), "n")
    none = F.lit(0).cast("bigint")
    inner = pair.where(F.col("w.case") == "u").select("w.type", none.alias("n"), none.alias("n_dot"), none.alias("lower"), F.col("n").alias("inner"))
    return known.unionByName(inner).groupBy("type").agg(*[F.sum(c).alias(c) for c in ("n", "n_dot", "lower", "inner")])


def _likelihood(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of ``both`` among ``a`` and ``b`` of ``n``."""
    def part(hit: Column, of: Column, p: Column) -> Column:
        return F.when((p <= 0) | (p >= 1), 0.0).otherwise(hit * F.ln(p) + (of - hit) * F.ln(1 - p))

    rest = n - a
    return -2 * (part(both, a, b / n) + part(b - both, rest, b / n) - part(both, a, both / a) - part(b - both, rest, (b - both) / rest))


def _letters(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def _weak(c: Column) -> Column:
    """Initials and numbers."""
    return c.rlike(r"^(\p{L}|#)$")


def fit(docs: DataFrame, id_col: str, text_col: str, words: Words | None = None) -> Model:
    """The model of all documents; null texts have no words."""
    words = _words(docs, id_col, text_col) if words is None else words
    counts = materialize(_counts(words.texts), "sentence-counts")
    total, dots = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_dot"), F.lit(0))).first()
    share = F.lit(min(max(dots / total, 1e-12), 1 - 1e-12) if total else 0.5)
    dot, plain = F.col("n_dot").cast("double"), (F.col("n") - F.col("n_dot")).cast("double")
    size = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    ratio = -2 * (dot * F.ln(share) + plain * F.ln(1 - share) - dot * F.ln(F.lit(0.99)) - plain * F.ln(F.lit(0.01)))
    score = ratio * F.exp(-size) * (F.length("type") - size + 1) * F.pow(size, -plain)
    abbreviations = counts.where((F.col("n_dot") > 0) & _letters(F.col("type"))).select(
        "type", "n_dot", (F.col("n") - F.col("n_dot")).alias("n_plain"), score.alias("score")).where(F.col("score") >= ABBREVIATION)
    abbreviations = materialize(abbreviations, "abbreviations")

    dotted = words.marked.where(F.col("mark") == "p").select("type", "next")
    dotted = dotted.join(abbreviations.select("type", F.lit(True).alias("abbr")), "type", "left")
    pairs = materialize(dotted.groupBy("type", "next", F.coalesce("abbr", F.lit(False)).alias("abbr")).agg(F.count(F.lit(1)).alias("both")), "sentence-pairs")
    n = F.lit(float(total))
    sure = pairs.where(~F.col("abbr") & ~_weak(F.col("type"))).groupBy("next").agg(F.sum("both").alias("both"))
    ends = float(sure.agg(F.coalesce(F.sum("both"), F.lit(0))).first()[0])
    of = lambda name, c: counts.select(F.col("type").alias(name), F.col("n").alias(c))
    starters = sure.join(of("next", "b"), "next").where(_letters(F.col("next")) & (F.col("b") >= F.col("both")))
    starters = starters.where((n / F.lit(ends or 1.0) > F.col("b") / F.col("both")) & (_likelihood(F.lit(ends or 1.0), F.col("b"), F.col("both"), n) >= STARTER))
    collocations = pairs.where((F.col("abbr") | _weak(F.col("type"))) & (F.col("both") > 1)).join(of("type", "a"), "type").join(of("next", "b"), "next")
    collocations = collocations.where((F.col("both") <= F.least("a", "b")) & (n / F.col("a") > F.col("b") / F.col("both"))
                                      & (_likelihood(F.col("a"), F.col("b"), F.col("both"), n) >= COLLOCATION))
    return Model(counts, abbreviations, materialize(starters.select(F.col("next").alias("type")), "sentence-starters"),
                 materialize(collocations.select("type", "next"), "sentence-collocations"))


def ends(words: Words, model: Model) -> DataFrame:
    """(id, ends): the places of the words that end a sentence inside of a document, ascending."""
    rows = words.marked
    yes = lambda name: F.lit(True).alias(name)
    rows = rows.join(model.abbreviations.select("type", yes("abbr")), "type", "left")
    rows = rows.join(model.collocations.select("type", "next", yes("pair")), ["type", "next"], "left")
    rows = rows.join(model.starters.select(F.col("type").alias("next"), yes("starter")), "next", "left")
    small = model.counts.where((F.col("lower") > 0) & (F.col("inner") == 0))
    rows = rows.join(small.select(F.col("type").alias("next"), yes("small")), "next", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    held = no("abbr") | F.col("type").rlike(r"^\p{L}$")
    stop = F.when(F.col("mark") == "e", True).when(F.col("mark") == "l", F.col("next_case") == "u").when(no("pair"), False) \
        .when((held | (F.col("type") == "#")) & (F.col("next_case") == "l"), False) \
        .when(held, no("starter") | ((F.col("next_case") == "u") & no("small"))).otherwise(True)
    return rows.where(stop).groupBy("id").agg(F.array_sort(F.collect_list("i")).alias("ends"))


def with_sentences(docs: DataFrame, id_col: str, text_col: str, model: Model | None = None, out: str = "sentences") -> DataFrame:
    """``docs`` with ``out``, the sentences of each text without the white space round
    them.  ``id_col`` is unique and not null; without ``model`` it is fitted on ``docs``."""
    words = _words(docs, id_col, text_col)
    model = model or fit(docs, id_col, text_col, words)
    found = docs.join(ends(words, model).withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left").drop("_id")
    found = found.withColumn("_p", pieces(F.coalesce(F.col(text_col), F.lit(""))))
    found = found.withColumn("_e", F.concat(F.coalesce("ends", F.array().cast("array<int>")), F.array(F.size("_p") - 1)))
    part = F.transform("_e", lambda e, k: F.trim(F.array_join(F.slice(
        "_p", F.when(k > 0, F.get("_e", k - 1)).otherwise(-1) + 2, e - F.when(k > 0, F.get("_e", k - 1)).otherwise(-1)), "")))
    return found.withColumn(out, F.when(F.size("_p") > 0, part).otherwise(F.array().cast("array<string>"))).drop("_p", "_e", "ends")
