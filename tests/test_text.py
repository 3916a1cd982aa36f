import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as TX


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


def test_html_basic(spark):
    html = ('<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x}</style>'
            '<script>var t="</p>";</script></head><body><!-- c <p>x</p> --><p>a  b</p>\n  <p>c&quot;d</p></body></html>')
    # tags vanish without a separator: the title runs into the first paragraph
    assert one(spark, TX.html_to_text, html) == 'T & Ua\nb\nc"d'


def test_html_quoted_gt(spark):
    assert one(spark, TX.html_to_text, '<a title="x > y">link</a>') == "link"


@pytest.mark.parametrize(("html", "expect"), [
    ("<a " + "x" * 40000 + ">t</a>", "t"),
    ("<p " + " ".join(f'a{i}="v"' for i in range(101)) + ">t</p>", "t"),
    ("<p " + " ".join(f'a{i}="v"' for i in range(6000)) + ">t</p>", "t"),
    ("<a " * 100000 + "x", "<a " * 100000 + "x"),
    ("t<!--" + "y<" * 150000, "t"),
    ("<!--" + "z" * 300000 + "--><script>" + "w" * 300000 + "</script>done", "done"),
])
def test_html_pathological_inputs_finish(spark, html, expect):
    t0 = time.time()
    assert one(spark, TX.html_to_text, html) == expect.strip()
    assert time.time() - t0 < 60


@pytest.mark.parametrize(("html", "expect"), [
    ("a &mdash; b &#8217; &#x27; &eacute; &hellip; &apos;", "a — b ’ ' é … '"),
    ("&amp;lt; &amp;amp; &AMP; &copy; &nbsp;x", "&lt; &amp; & © \u00a0x"),
    ("&#128512; &#x1F600; &#0; &#xD800; &#9999999; &#146; &#0146;", "😀 😀 \ufffd \ufffd \ufffd ’ ’"),
    ("R&D; a & b &unknown; &", "R&D; a & b &unknown; &"),
    ("x<script>var a = '<p>'; leak", "x"),
    ("x<style>p{} leak", "x"),
    ("x<!-- never closed <p>leak</p>", "x"),
    ("<a href=x'y>it's</a>", "it's"),
    ("<p title='a > b' class=\"c\">t</p>", "t"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
])
def test_html_expected_text(spark, html, expect):
    assert one(spark, TX.html_to_text, html) == expect


def test_token_count(spark):
    assert one(spark, TX.token_count, "Hello world 123456") == 4
    assert one(spark, TX.token_count, "") == 0
    assert one(spark, TX.token_count, "it's") == 2


@pytest.mark.parametrize("url,expect", [
    ("http://a/x;p/y?q", "http://a/x;p/y"),
    ("http://a/x/y;p?q#f", "http://a/x/y"),
    ("http://a.com?q=1#f", "http://a.com"),
    ("http://a.com//x/y", "http://a.com//x/y"),
    ("http://a.com/a/../b", "http://a.com/b"),
    ("http://a.com/a/./b/", "http://a.com/a/b/"),
    ("http://[bad/x?y", None),
    ("http://bad]/x", None),
    ("http://[::1]:80/x?y", "http://[::1]:80/x"),
    ("http://a.com" + "/s" * 30000 + "/../b?q", "http://a.com" + "/s" * 29999 + "/b"),
])
def test_canonical_url(spark, url, expect):
    assert one(spark, TX.canonical_url, url) == expect


def test_wiki_title(spark):
    u = "https://en.wikipedia.org/wiki/Page_1%20C%2B%2B+x/sub"
    assert one(spark, TX.wiki_title, u) == "Page 1 C+++x"
    assert one(spark, TX.wiki_title, "https://en.wikipedia.org/w/AC") is None
    assert one(spark, TX.wiki_title, "https://en.wikipedia.org/wiki/%ZZ") is None
    assert one(spark, TX.is_wikipedia, "https://user@en.wikipedia.org:80/wiki/X") is True
    assert one(spark, TX.is_wikipedia, "mailto:x@y") is False


def test_ad_link(spark):
    assert one(spark, TX.is_ad_link, "https://www.google.com/aclk?sa=1") is True
    assert one(spark, TX.is_ad_link, "HTTP://google.co.uk/x/aclk?") is True
    assert one(spark, TX.is_ad_link, "https://example.com/aclk?sa=1") is False


@pytest.mark.parametrize("reply,expect", [
    ("Yes", True), ("No.", False), ("yes and no", True), ("I know", False), ("maybe", None), (None, None),
])
def test_verdict(spark, reply, expect):
    assert one(spark, TX.verdict, reply) is expect


@pytest.mark.parametrize("reply,expect", [
    ("TableAgent or DocAgent", "DocAgent"), ("ScienceAgent", "ScienceAgent"), ("none", None),
])
def test_agent_name(spark, reply, expect):
    assert one(spark, TX.agent_name, reply) == expect


def test_commands(spark):
    df = spark.createDataFrame([("Exit",), ("please exit now",), ("smart tutor",), ("what?",)], "v string")
    exact = [r[0] for r in df.select(TX.command("v", "exact")).collect()]
    contains = [r[0] for r in df.select(TX.command("v", "contains")).collect()]
    assert exact == ["exit", "question", "smart tutor", "question"]
    assert contains == ["exit", "exit", "smart tutor", "question"]


def test_file_kind(spark):
    names = ["a.txt", "b.CSV", "c.pdf", "d.docx", "e.xlsx", "f.PNG", "g.doc", "h.tar.gz", "noext"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    kinds = [r[0] for r in df.select(TX.file_kind("v")).collect()]
    assert kinds == ["text", "table", "pdf", "docx", "table", "image", "docx", "unsupported", "unsupported"]


def test_py_strip_and_words(spark):
    s = "\x1c a b\tc  "
    assert one(spark, TX.py_strip, s) == s.strip()
    df = spark.createDataFrame([(s,)], "v string")
    assert df.select(TX.words("v")).first()[0] == s.split()
