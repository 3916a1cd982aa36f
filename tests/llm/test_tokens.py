"""Files of ids: codes, round trips, and the ids of the tokenizers library."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from odd import frame, rows
from tessera.llm import huffman
from tessera.llm.tokens import PieceTokenizer
from tessera.session import work_dir


def kraft_optimal(counts, top):
    """Cost of the best code with lengths up to ``top``, by trying all sorted lengths."""
    best, counts = None, sorted(counts, reverse=True)

    def go(i, low, space, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(counts):
            best = cost
            return
        for length in range(low, top + 1):
            left = space - 2 ** (top - length)
            if left >= 0 and left >= len(counts) - i - 1:
                go(i + 1, length, left, cost + counts[i] * length)

    go(0, 1, 2**top, 0)
    return best


def test_lengths_are_optimal_and_limited():
    r = random.Random(3)
    for _ in range(60):
        counts = np.array([r.choice([0, 1, 1, 2, 5, 50, 1000]) for _ in range(r.randint(2, 8))])
        used = counts[counts > 0]
        if len(used) < 2:
            continue
        for top in range(max(1, int(np.ceil(np.log2(len(used))))), 8):
            lengths = huffman.code_lengths(counts, top)
            assert lengths.max() <= top and (lengths[counts == 0] == 0).all()
            assert int((counts * lengths).sum()) == kraft_optimal(used.tolist(), top)
            codes, order = huffman.canonical(lengths)
            words = [format(int(codes[i]), f"0{lengths[i]}b") for i in order]
            assert words == sorted(words) and not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 900).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=901) + 1, 20)
    bits, marks = huffman.encode(ids, huffman.canonical(lengths)[0], lengths)
    assert (huffman.Decoder(lengths).decode(bits, marks, n) == ids).all()
    assert len(marks) == -(-n // huffman.STEP)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_s_ids(spark, name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    r = random.Random(1)
    alphabet = ["a", "the", "É", "ß", "日", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'", "1", "23", "!", "...", " ", " ", "<|endoftext|>", "\x00", "é", "İ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [t or "" for _, t, *_ in rows()]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = PieceTokenizer(path).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def want(docs, name, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return [(d[0], [*plain.encode(d[1] or "", add_special_tokens=False).ids, end]) for d in docs]


def crc(ids):
    a = array("I", ids)
    return zlib.crc32(a.tobytes())


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_files_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(huffman, "BLOCK", block)
    path = work_dir(spark, "test-ids")
    huffman.write_ids(frame(spark), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    got = sorted(huffman.digest(spark, path).collect(), key=lambda r: r.start)
    plain = sorted(huffman.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [(r.id, r.n_tokens, zlib.crc32(r.ids)) for r in plain] == [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got]
    expected = want(rows(), "byte_bpe_50k.json", 2)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((i, len(x), crc(x)) for i, x in expected), key=repr)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)


def test_empty_table(spark):
    path = work_dir(spark, "test-ids")
    huffman.write_ids(frame(spark).limit(0), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    assert huffman.read_ids(spark, path).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_small_memory_gives_the_same_ids(name):
    """Pieces that were forgotten are learned again, kept ones are numbered anew."""
    path, r = public_tokenizers.path(name), random.Random(6)
    words = ["".join(r.choice("abcdeéü日 ") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(r.choices(words[:30], k=20) + r.choices(words, k=10)) for _ in range(200)]
    small, plain = PieceTokenizer(path, keep=40), PieceTokenizer(path)
    for low in range(0, 200, 10):
        for a, b in zip(small.encode(texts[low:low + 10]), plain.encode(texts[low:low + 10]), strict=True):
            assert a.tolist() == b.tolist()
    assert len(small.words) + len(small.parts) < len(plain.words) + len(plain.parts)


def test_counts_are_taken_while_tokenising(spark):
    """The codebook has a code for each id that occurs, and the most frequent has the shortest."""
    path = work_dir(spark, "test-ids")
    huffman.write_ids(frame(spark), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    count = {}
    for _, ids in want(rows(), "byte_bpe_50k.json", 2):
        for i in ids:
            count[i] = count.get(i, 0) + 1
    book = {r.id: r.bits for r in spark.read.parquet(f"{path}/codebook").collect()}
    assert set(book) == set(count) and book[max(count, key=count.get)] == min(book.values())
