from tessera.plans import ask as A


def test_web_namespace_sections_wiki_pages(spark, tmp_path):
    d = str(tmp_path)
    html_wiki = "<html><body><h1>Apple</h1><p>Intro apple orchard</p><h2 class='x'><span>History</span></h2><p>apple trees grew</p>" \
                "<h2>See also</h2><p>banana secret</p><h3>Deeper</h3><p>hidden too</p><h2>Uses</h2><p>pies</p></body></html>"
    html_plain = "<html><body><p>apple pie recipe</p>\n<p>== See also ==</p>\n<p>banana kept</p></body></html>"
    spark.createDataFrame(
        [(1, "https://en.wikipedia.org/wiki/Apple?x=1", html_wiki), (2, "https://example.com/pie", html_plain)],
        "page_id long, url string, html string",
    ).write.parquet(f"{d}/pages.parquet")
    qs = spark.createDataFrame([("7:0", "apple banana")], "qid string, text string")
    store = A.web_namespace(spark, d, qs)
    got = {r["source_id"]: r["context"] for r in store.collect()}
    # the wiki page keeps Summary and History, drops the "See also" section
    assert "secret" not in got[1] and "hidden" not in got[1] and "trees" in got[1] and "pies" in got[1]
    assert {r["source_id"]: r["title"] for r in store.collect()} == {1: "Apple", 2: None}
    # a plain page keeps all its visible text
    assert "kept" in got[2]
