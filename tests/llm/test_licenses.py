import random
import re

import regex

from odd import frame, rows
from tessera.llm import licenses

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})), words


def check(got, docs):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr)
    assert got == sorted(((d[0], *brute(d[1])[:5]) for d in docs), key=repr)


def test_base_columns_on_odd_rows(spark):
    got = licenses.digest(licenses.scan(frame(spark))).collect()
    check(got, rows())
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(frame(spark).limit(0)).collect() == []


def test_base_columns_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = licenses.digest(licenses.scan(docs)).collect()
    check(got, [tuple(r) for r in docs.collect()])
    assert sum(r.n_base for r in got) > 20


def test_fuzzy_places_equal_a_search_of_the_whole_text():
    r = random.Random(8)
    for notice in licenses.NOTICES:
        for _ in range(60):
            phrase = list(notice.words)
            for _ in range(r.randint(0, notice.edits + 2)):
                k = r.randrange(1, len(phrase) - 1)
                phrase[k:k + r.randint(0, 1)] = r.choice(["", "x", "z"])
            text = licenses.normalise(("Lorem ipsum é " * r.randint(0, 3) + "".join(phrase) + " dolor license " * r.randint(0, 2)).encode())[0]
            spans = licenses.spans_of(text, notice)
            best = regex.search(rf"(?b)(?<!\S)(?:{regex.escape(notice.words)}){{e<={notice.edits}}}(?!\S)", text.decode())
            assert bool(spans) == bool(best), (notice.words, text)
            if best:
                assert min(e for _, _, e in spans) == sum(best.fuzzy_counts)
            for s, e, edits in spans:
                m = regex.fullmatch(rf"(?:{regex.escape(notice.words)}){{e<={notice.edits}}}", text[s:e].decode())
                assert m and edits <= notice.edits


def test_only_blanks_part_words_of_a_normalised_text():
    """U+00A0 and U+3000 belong to words, so a place neither starts nor ends at one."""
    mit = licenses.NOTICES[0]
    for glue in (" ", "　", "X"):
        for raw in (f"foo{glue}mit licence bar", f"foo mit licence{glue}bar"):
            assert licenses.spans_of(licenses.normalise(raw.encode())[0], mit) == []
    assert len(licenses.spans_of(licenses.normalise("foo mit licence bar x".encode())[0], mit)) == 1
