"""Toxic spans by a linear-chain conditional random field.

Fitting takes a bounded sample of labelled rows (``SAMPLE`` rows a class) to the
driver.  Labels are given for documents, so tokens are labelled first: a word or
word beginning marks toxic tokens if it occurs in many toxic documents and
hardly in clean ones (each document counts once, and documents with mostly equal
words count once together, so a large group of near copies does; what stands
round the word doesn't matter).  The field has two states, clean and toxic; a token's score is a sum of
hashed weights of its word and its beginnings, and neighbours are tied by
transition weights.  It is fitted to the labelled tokens by maximum likelihood.

Scoring is row-local: forward-backward marginals of every token of every
sentence, runs of tokens at 1/2 or more as offending spans, and a document score
from the highest marginal and the expected number of offending tokens, fitted to
the labels of the sample and set right for the share of label 1 in all labels.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pick, strings

#: Rows of each label that are fitted at most, and characters of such a text at most.
SAMPLE, MAX_CHARS = 2000, 1 << 16
#: Weights, lengths of word beginnings, tokens after which a sentence is cut, rounds of fitting.
WEIGHTS, STEMS, LONGEST, ROUNDS = 1 << 18, (3, 4, 5, 6, 7), 512, 40
#: Hashes that stand for a document's words, and the share of them that near copies have in common at least.
HASHES, ALIKE = 128, 0.5
#: Words remembered per worker.
KNOWN = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"[^\W\d_]+|[.!?]+\s|\n")  # words and ends of sentences


def sentences(end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of words of the sentences with words, in order; those over
    ``LONGEST`` are cut.  ``end``: is the item the end of a sentence; ``text``: its text's number."""
    at, text = np.cumsum(end)[~end], text[~end]
    n = len(at)
    new = np.ones(n, bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(text) != 0)
    place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.diff(np.flatnonzero(place % LONGEST == 0), append=n)


def features(word: str) -> list[str]:
    word = word.lower()
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


def _slots(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f) % WEIGHTS for f in features(word)]


class Chains:
    """Sequences of the given lengths side by side: place t of all that are
    longer than t lies together, the longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        size = lengths[self.order]
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        longest = int(size[0]) if len(size) else 0
        self.active = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        t = np.repeat(np.arange(longest), self.active)
        self.at = first[np.arange(len(t)) - self.starts[t]] + t  # token of each cell

    def marginals(self, scores: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the toxic state for each token, with the expected number of first
        tokens in each state and of steps between states."""
        e = np.ones((len(self.at), 2))
        e[:, 1] = np.exp(np.clip(scores[self.at], -30, 30))
        e /= e.sum(1, keepdims=True)
        ahead, back = np.empty_like(e), np.ones_like(e)
        first, move = np.exp(start), np.exp(step)
        for t, n in enumerate(self.active):
            s = slice(self.starts[t], self.starts[t] + n)
            before = first if t == 0 else ahead[self.starts[t - 1]:self.starts[t - 1] + n] @ move
            a = before * e[s]
            ahead[s] = a / a.sum(1, keepdims=True)
        steps = np.zeros((2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            n, low = self.active[t], self.starts[t - 1]
            s = slice(self.starts[t], self.starts[t] + n)
            right = e[s] * back[s]
            b = right @ move.T
            pair = ahead[low:low + n, :, None] * move * right[:, None, :]
            steps += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            back[low:low + n] = b / b.sum(1, keepdims=True)
        both = ahead * back
        both /= both.sum(1, keepdims=True)
        out = np.empty(len(self.at))
        out[self.at] = both[:, 1]
        return out, both[: self.active[0] if len(self.active) else 0].sum(0), steps


def near_copies(of_word: np.ndarray, doc: np.ndarray, words: int, docs: int) -> np.ndarray:
    """Group of each document, by its first one: documents that share ``ALIKE``
    of the words that either has (as their least hashes tell).  ``of_word``, ``doc``: of each token."""
    pair = np.unique(doc * words + of_word)
    some, starts = np.unique(pair // words, return_index=True)
    pair %= words
    group, least = np.arange(docs), np.empty((len(some), HASHES), np.uint32)
    rng = np.random.default_rng(10)
    for k in range(HASHES if len(some) else 0):
        least[:, k] = np.minimum.reduceat(rng.integers(0, 1 << 32, words, dtype=np.uint32)[pair], starts)
    first, firsts = np.empty_like(least), []  # of the groups
    for d, own in zip(some.tolist(), least, strict=True):
        n = len(firsts)
        alike = np.flatnonzero((first[:n] == own).sum(1) >= ALIKE * HASHES)
        if len(alike):
            group[d] = firsts[alike[0]]
        else:
            first[n] = own
            firsts.append(d)
    return group


def telling(words: list[str], of_word: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Mask over ``words``: those that mark toxic tokens.  ``of_word``, ``doc``:
    of each token; ``toxic``: of each document."""
    names: dict[str, int] = {}
    if not words or not toxic.any() or toxic.all():
        return np.zeros(len(words), bool)
    feature, sizes = array("q"), array("q")
    for w in words:
        found = features(w)
        feature.extend(names.setdefault(f, len(names)) for f in found)
        sizes.append(len(found))
    feature, sizes = np.array(feature), np.array(sizes)
    word, starts = np.repeat(np.arange(len(words)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    vote = 2 * near_copies(of_word, doc, len(words), len(toxic)) + toxic  # of each document: its group and label
    total = np.zeros(2 * len(names))
    for k in range(int(sizes.max())):  # the k-th feature of each token: the word, then its beginnings by length
        has = np.flatnonzero(starts[of_word] + k < starts[of_word + 1])
        # each feature once per vote
        key = np.unique(feature[starts[of_word[has]] + k] * (2 * len(toxic)) + vote[doc[has]])
        total += np.bincount(key // (2 * len(toxic)) * 2 + key % 2, minlength=2 * len(names))
    clean, bad = total.reshape(-1, 2).T
    share, base = bad / np.maximum(clean + bad, 1e-9), (np.unique(vote) % 2).mean()
    inside = np.clip(share, 1e-9, 1 - 1e-9)
    gain = (clean + bad) * (inside * np.log(inside / base) + (1 - inside) * np.log((1 - inside) / (1 - base)))
    good = (share >= 0.9) & (bad >= 3) & (gain > np.log(max(2, (bad >= 2).sum())) + 1)
    out = np.zeros(len(words), bool)
    out[word[good[feature]]] = True
    return out


@dataclass
class Model:
    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray
    document: np.ndarray  # of 1, the highest log odds, the expected offending tokens

    def word_score(self, word: str) -> float:
        return float(self.weights[_slots(word)].sum())

    def document_scores(self, p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``p``: marginals of the tokens, ``tokens``: their number per document."""
        return 1 / (1 + np.exp(-self.facts(p, tokens) @ self.document))

    @staticmethod
    def facts(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        ends = np.cumsum(tokens)
        some = tokens > 0
        best, hits = np.full(len(tokens), 1e-4), np.zeros(len(tokens))
        if some.any():
            at = (ends - tokens)[some]
            best[some] = np.maximum.reduceat(p, at)
            hits[some] = np.add.reduceat(np.where(p >= 0.5, p, 0), at)
        best = np.clip(best, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(len(tokens)), np.log(best / (1 - best)) / 4, np.log1p(hits)], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1.0, 1.0])
        w -= np.linalg.solve(hess, x.T @ (p - y) + w * [1e-3, 1.0, 1.0])
        w[1:] = np.maximum(w[1:], 0)  # a more offending document never scores lower
    return w


def train(texts: list[str], labels: list[int], share: float) -> Model:
    """``share``: of label 1 among all labelled rows."""
    toxic = np.array(labels, bool)
    index: dict[str, int] = {}
    items = [[index.setdefault(x.lower(), len(index)) if x[0].isalpha() else -1 for x in _ITEM.findall(t)] for t in texts]
    of_text = np.repeat(np.arange(len(texts)), [len(x) for x in items])
    flat = np.fromiter(chain.from_iterable(items), np.int64, len(of_text))
    lengths, words, of_word = sentences(flat < 0, of_text), list(index), flat[flat >= 0]
    per_doc = np.bincount(of_text[flat >= 0], minlength=len(texts))
    doc = np.repeat(np.arange(len(texts)), per_doc)
    marks = telling(words, of_word, doc, toxic)
    y = marks[of_word] & toxic[doc]
    slots = [_slots(w) for w in words]
    rows = np.repeat(np.arange(len(words)), [len(s) for s in slots])
    cols = np.array([i for s in slots for i in s], np.int64)
    chains, edges = Chains(lengths), np.cumsum(lengths) - lengths
    inner = np.ones(len(of_word), bool)
    inner[edges] = False
    moves = np.bincount(2 * y[:-1][inner[1:]] + y[1:][inner[1:]], minlength=4).reshape(2, 2) if len(y) else np.zeros((2, 2))
    firsts = np.bincount(y[edges].astype(int), minlength=2) if len(edges) else np.zeros(2)
    size = [WEIGHTS, 2, 4]
    theta, memory, speed = np.zeros(sum(size)), np.zeros(sum(size)), np.zeros(sum(size))
    theta[WEIGHTS + 1] = -2.0
    n = max(1, int(y.sum()))
    for k in range(1, ROUNDS + 1 if len(of_word) else 1):  # Adam on the likelihood per toxic token
        start, step = theta[WEIGHTS:WEIGHTS + 2], theta[WEIGHTS + 2:].reshape(2, 2)
        score = np.bincount(rows, theta[cols], len(words))
        p, first, steps = chains.marginals(score[of_word], start, step)
        by_word = np.bincount(of_word, p - y, len(words))
        grad = np.concatenate([np.bincount(cols, by_word[rows], WEIGHTS), first - firsts, (steps - moves).ravel()]) / n + 1e-5 * theta
        memory = 0.9 * memory + 0.1 * grad
        speed = 0.999 * speed + 0.001 * grad**2
        theta = theta - 0.3 * (memory / (1 - 0.9**k)) / (np.sqrt(speed / (1 - 0.999**k)) + 1e-8) * (grad != 0)
    model = Model(theta[:WEIGHTS].astype(np.float32), theta[WEIGHTS:WEIGHTS + 2], theta[WEIGHTS + 2:].reshape(2, 2), np.zeros(3))
    p = np.zeros(0)
    if len(of_word):
        score = np.bincount(rows, model.weights[cols], len(words))
        p = chains.marginals(score[of_word], model.start, model.step)[0]
    odds = lambda x: np.log(x / (1 - x))
    inside = lambda x: min(max(x, 1e-3), 1 - 1e-3)
    if len(texts):
        model.document = _logistic(model.facts(p, per_doc), toxic.astype(float))
        model.document[0] += odds(inside(share)) - odds(inside(float(toxic.mean())))
    else:
        model.document[0] = odds(inside(share))
    return model


class Scorer(dict):
    """Marginals of whole texts; remembers the scores of up to ``KNOWN`` words
    (and infinity for the ends of sentences)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, item: str) -> float:
        self[item] = value = self.model.word_score(item) if _WORD.match(item) else np.inf
        return value

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of all words of the texts, and the number of words of each."""
        if len(self) > KNOWN:
            self.clear()
        items = [list(map(self.__getitem__, _ITEM.findall(t))) for t in texts]
        of_text = np.repeat(np.arange(len(texts)), [len(x) for x in items])
        flat = np.fromiter(chain.from_iterable(items), np.float64, len(of_text))
        end = np.isinf(flat)
        p = Chains(sentences(end, of_text)).marginals(flat[~end], self.model.start, self.model.step)[0]
        return p, np.bincount(of_text[~end], minlength=len(texts))


def offending(text: str, p: np.ndarray) -> list[dict]:
    """Character offsets of runs of tokens whose marginal is 1/2 or more."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "probability": max(out[-1]["probability"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "probability": float(p[i])})
            last = i
    return out


def fit(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows where ``trains`` (over ``doc_id``) holds, at most
    ``sample`` of each label, in the order of a hash of their ids.

    Rows without id, label or document don't count; of repeated labels the
    largest does; texts over ``MAX_CHARS`` characters aren't fitted; without any
    rows every score is low and the same."""
    marked = pick(labels, doc_id=id_col, toxic=label_col).where("doc_id is not null and toxic is not null").where(trains)
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = marked.where("toxic = 1").orderBy(*order).limit(sample).union(marked.where("toxic = 0").orderBy(*order).limit(sample))
    # at most 2 * sample ids are broadcast, and as many texts of bounded length come back
    rows = pick(docs, doc_id=id_col, text=text_col).where(F.length("text") <= MAX_CHARS).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy(*order).collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], count.get(1, 0) / max(1, sum(count.values())))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, n_tokens, spans (start, end, probability; in characters).

    A null text is empty; a text without words gets the lowest score there is;
    repeated rows and null ids are scored row by row; an empty table gives no
    rows; other columns aren't read."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in it:
            texts = strings(b.column(1))
            low = 0
            while low < len(texts):  # a few million characters at a time
                high, held = low, 0
                while high < len(texts) and held < 4 << 20:
                    held += len(texts[high])
                    high += 1
                p, tokens = scorer.marginals(texts[low:high])
                ends = np.cumsum(tokens)
                found = [offending(t, p[e - n:e]) if n and p[e - n:e].max() >= 0.5 else []
                         for t, e, n in zip(texts[low:high], ends.tolist(), tokens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), pa.array(model.document_scores(p, tokens)), pa.array(tokens), pa.array(found, pa.list_(span))],
                    names=["doc_id", "score", "n_tokens", "spans"])
                low = high

    rows = pick(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, n_tokens long, spans array<struct<start: long, end: long, probability: double>>")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learned from; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
