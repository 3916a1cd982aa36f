import random

import pytest

from tessera.operators import boundaries

NOUNS = "rain letter road sun book man shelf boy river house window garden table paper summer winter music story village market".split()
FIXED = [
    ["Dr. Smith met Dr. Jones.", "The two spoke, e.g. about rain.", "It was 3.14 metres deep."],
    ["We saw Dr. Brown there.", "She read Mr. White, e.g. his letter!", "Was it late?", "The house burned."],
    ["It rained on the garden...", "The sun came.", "Then a boy... laughed."],
    ["J. K. Miller wrote it.", "The book (see vol. 2) was sold.", '"It is a story."', "The man agreed (on paper)."],
]


def corpus():
    """Plain sentences in which every noun stands at all places, some with abbreviations."""
    r = random.Random(4)
    out = []
    for _ in range(150):
        text = []
        for _ in range(6):
            words = [r.choice(["The", "It", "A"])] + r.choices([*NOUNS, "the", "it", "a", "and", "was", "there", "2", "7", "deep"], k=r.randint(4, 9))
            if r.random() < 0.5:
                words.insert(r.randint(1, 3), r.choice(["Dr. Smith", "Mr. White", "Dr. Jones", "e.g. rain", "vol. 2", "vol. 7", "J. Miller"]))
            text.append(" ".join([*words, r.choice(NOUNS)]) + r.choice("..!?"))
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([*enumerate(corpus())] + [(800 + i, " ".join(x)) for i, x in enumerate(FIXED)] + [(900, None), (901, ""), (902, "  "), (903, "no end"), (904, "A. B. C. D.")], "id long, text string")
    model = boundaries.fit(docs, "id", "text")
    return model, {r["id"]: r["sentences"] for r in boundaries.with_sentences(docs, "id", "text", model).collect()}


def test_abbreviations_are_learned(found):
    types = {r["type"] for r in found[0].abbreviations.collect()}
    assert {"dr", "mr", "e.g", "vol"} <= types and not types & {*NOUNS, "it", "the", "deep", "there"}


@pytest.mark.parametrize("i", range(len(FIXED)))
def test_periods_inside_of_sentences_do_not_split(found, i):
    assert found[1][800 + i] == FIXED[i]


def test_empty_and_unended_texts(found):
    got = found[1]
    assert got[900] == got[901] == got[902] == [] and got[903] == ["no end"]
    for i, text in enumerate(corpus()):
        assert " ".join(got[i]) == text and 5 <= len(got[i]) <= 6


def test_starters(found):
    assert {r["type"] for r in found[0].starters.collect()} >= {"the", "it"}


def test_an_empty_corpus(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert boundaries.with_sentences(docs, "id", "text").collect() == []
    assert boundaries.fit(docs, "id", "text").abbreviations.collect() == []


def test_counts_of_the_vocabulary_are_those_of_all_words(spark):
    from pyspark.sql import functions as F

    rows = [(1, "The  Rain fell. The rain\tFell! iPhone ÉTÉ 𝐀b E.g. the Rain, rain... No. 7"), (2, "rain Rain"), (3, ""), (4, None), (5, "Rain")]
    docs = spark.createDataFrame(rows, "id long, text string")
    words = boundaries._words(docs, "id", "text")
    got = {r["type"]: tuple(r)[1:] for r in boundaries._counts(words.texts).collect()}
    want = {}
    for r in words.texts.select("id", F.transform("p", boundaries.word).alias("w")).collect():
        for i, w in enumerate(r["w"]):
            c = want.setdefault(w["type"], [0, 0, 0, 0])
            new = 1, w["mark"] == "p", w["case"] == "l", w["case"] == "u" and i > 0 and r["w"][i - 1]["mark"] == ""
            want[w["type"]] = [a + int(b) for a, b in zip(c, new)]
    assert got == {k: tuple(v) for k, v in want.items()} and got["rain"][3] == 3
