"""Token ids of whole texts, many texts at a time.

The tokenizers library does the encoding; this helper hands it each distinct
piece of text once per worker instead of once per place.

* Plain texts (ASCII and the letters of Latin-1) are split as both supported
  pre-tokenizers split them, and the library's model gives the ids of each
  distinct piece.
* Others are cut only before a space or line end between characters that aren't
  white space, where both pre-tokenizers cut too; the whole library encodes each
  distinct part.  So do all texts if a tokenizer turns out not to split as expected.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER_THAN_PLAIN = re.compile(rf"[^\t\n\r -~{_LETTER}]")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How each kind splits a plain text; white space goes, or belongs to the piece behind it.
_WORDS = re.compile(rf"{_ENDINGS}|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")
_SPACED = re.compile(rf"{_ENDINGS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_PROBE = "It's a Mix, of 12 Wörds\n  and \t<s> o'clock!? I'll "


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the character of that number if it
    is printable, the others as characters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_characters()


class _Known(dict):
    """Number of each piece; a new one gets the next number."""

    def __init__(self, numbers: list, new: list):
        super().__init__()
        self.numbers, self.new = numbers, new

    def __missing__(self, piece: str) -> int:
        self[piece] = at = self.numbers[0]
        self.numbers[0] += 1
        self.new.append((at, piece))
        return at


class PieceTokenizer:
    """``keep``: distinct pieces remembered before all but the most frequent are forgotten."""

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        self.keep = keep
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("Aé") == "aé"
        self.split = None
        self.forget()
        want = self.library.encode(_PROBE, add_special_tokens=False).ids
        for self.split in (_WORDS, _SPACED, None):
            if self.split is None or self.encode([_PROBE])[0].tolist() == want:
                break
        self.forget()

    def forget(self) -> None:
        numbers = [0]
        self.numbers, self.new_words, self.new_parts = numbers, [], []
        self.words, self.parts = _Known(numbers, self.new_words), _Known(numbers, self.new_parts)
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)  # how often each piece has been met

    def thin(self) -> None:
        """Keep the quarter of ``keep`` that is met most."""
        kept = np.zeros(len(self.seen), bool)
        kept[np.argsort(-self.seen, kind="stable")[:self.keep // 4]] = True
        number = (np.cumsum(kept) - 1).tolist()
        words, parts = ({p: number[n] for p, n in known.items() if kept[n]} for known in (self.words, self.parts))
        starts, sizes, seen, ids = self.starts[kept], self.sizes[kept], self.seen[kept], self.ids
        self.forget()
        self.words.update(words)
        self.parts.update(parts)
        self.numbers[0] = len(sizes)
        self.starts, self.sizes, self.seen = np.cumsum(sizes) - sizes, sizes, seen // 2
        self.ids = ids[np.repeat(starts - self.starts, sizes) + np.arange(sizes.sum())]

    def learn(self) -> None:
        """The ids of the new pieces."""
        n = self.numbers[0] - len(self.starts)
        if not n:
            return
        base, found = len(self.starts), [None] * n
        tokenize = self.library.model.tokenize
        for at, piece in self.new_words:
            # printable ASCII but the blank stands for itself
            mapped = piece.replace(" ", _BYTES[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
            found[at - base] = [t.id for t in tokenize(mapped)]
        parts = self.library.encode_batch_fast([p for _, p in self.new_parts], add_special_tokens=False)
        for (at, _), e in zip(self.new_parts, parts, strict=True):
            found[at - base] = e.ids
        self.new_words.clear()
        self.new_parts.clear()
        sizes = np.fromiter(map(len, found), np.int64, n)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])

    def pieces(self, text: str) -> list[int]:
        if self.split is None or _OTHER_THAN_PLAIN.search(text):
            return [self.parts[p] for p in _SAFE.split(text)]
        return list(map(self.words.__getitem__, self.split.findall(text.lower() if self.lower else text)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        group: list[list[int]] = []
        held = 0
        for text in texts:
            group.append(self.pieces(text))
            held += len(group[-1])
            if held > 1 << 18:
                out += self._ids(group)
                group, held = [], 0
        return out + self._ids(group)

    def _ids(self, group: list[list[int]]) -> list[np.ndarray]:
        if not group:
            return []
        self.learn()
        per_text = np.fromiter(map(len, group), np.int64, len(group))
        at = np.fromiter(chain.from_iterable(group), np.int64, int(per_text.sum()))
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        self.seen = np.bincount(at, minlength=self.numbers[0])[:self.numbers[0]] + np.pad(self.seen, (0, self.numbers[0] - len(self.seen)))
        if self.numbers[0] > self.keep:
            self.thin()
        return np.split(flat, ends[np.cumsum(per_text)][:-1])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PieceTokenizer:
    """One per file and worker process."""
    return PieceTokenizer(path)
