"""Documents with every awkward case, for the tests of all operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, fp long, row string, size int, kept string, `salt` int"

LONG = "Alpha beta gamma delta epsilon. Mit License zeta eta theta iota\n" * 6000


def rows():
    plain = "One two three four five six seven eight nine ten; released under the MIT License and more words here."
    texts = [None, "", " \t\n\x0b\f\r ", "x", "été 日本語 words ß", plain, plain, LONG, "\x00 nul   line \x85 sep nbsp", "a b c " * 40, "<|endoftext|> [UNK] </w>"]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 1, 7, 7, "r", 3, "k", 0) for i, t in enumerate(texts)]
    out += [(None, plain, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    out += [out[5]] * 3 + [out[1]] * 2  # rows that repeat as a whole
    out += [(5, "another text with the same id", "de", "s1", 1, 7, 7, "r", 3, "k", 0)]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
