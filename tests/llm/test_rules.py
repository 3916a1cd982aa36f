import re
from collections import Counter

from odd import frame, rows
from tessera.llm import rules


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {k for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_figures_on_odd_rows(spark):
    got = rules.quality(frame(spark)).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[c] for c in cols)) for r in got), key=repr) == sorted(((d[0], *brute(d[1])) for d in rows()), key=repr)
    assert not any(r.kept and (r.base_failed or r.rejected_by) for r in got)
    assert rules.quality(frame(spark).limit(0)).collect() == []


def test_verdict_is_the_same_in_every_order(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.kept for r in rules.quality(docs).collect()}
    order = rules.cascade_order
    monkeypatch.setattr(rules, "cascade_order", lambda *a: order(*a)[::-1])
    assert {r.doc_id: r.kept for r in rules.quality(docs, sample_rows=20).collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_order_is_by_rejection_per_cost(spark):
    docs = rules.word_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    found = rules.cascade_order(docs, rules.verdict_rules())
    rates = [share / cost for _, cost, share in found]
    assert rates == sorted(rates, reverse=True) and len(found) == 6


def test_keep_good_keeps_columns_and_clean_rows(spark):
    df = frame(spark)
    got = rules.keep_good(df)
    assert got.columns == df.columns
    want = Counter((r.doc_id, r.n_words) for r in rules.quality(df).where("kept").collect())
    assert Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in got.collect()) == want


def test_no_python_on_the_main_path(spark):
    plan = rules.quality(frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
