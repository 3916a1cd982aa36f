"""Tables derived by Spark from the given ones, standing in for inputs the
test data lacks (wiki text, file names, utterances, URLs, table files, ...).

Each derivation is deterministic and has a DuckDB twin in the oracle SQL.
Every row of the source table is used; attributes are derived from ids,
rows are never filtered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.compact import compact

# Fixed values (fixture design): heading names and file extensions.
WIKI_HEADINGS = ["History", "See also", "Overview", "References", "Usage", "Notes"]
FILE_EXTENSIONS = ["txt", "CSV", "pdf", "docx", "xlsx", "png", "doc", "tar.gz"]
TABLE_HEADER = "l_orderkey,l_partkey,l_linenumber,l_returnflag,l_linestatus"


def wikitext(docs: DataFrame) -> DataFrame:
    """``(doc_id, w)``: paragraph 0 is the summary; paragraph i > 0 gets a
    heading line of level ``2 + (doc_id + i) % 3`` named by
    ``(doc_id * 7 + i) % 6``."""
    names = F.array(*[F.lit(n) for n in WIKI_HEADINGS])
    did = F.col("doc_id")

    def para(p, i):
        level = (F.lit(2) + (did + i) % 3).cast("int")
        eq = F.repeat(F.lit("="), level)
        name = F.get(names, ((did * 7 + i) % 6).cast("int"))
        return F.when(i == 0, p).otherwise(F.concat(eq, F.lit(" "), name, F.lit(" "), eq, F.lit("\n"), p))

    return docs.select(did, F.array_join(F.transform(F.split("text", "\n"), para), "\n").alias("w"))


def file_names(docs: DataFrame, *keep: str) -> DataFrame:
    exts = F.array(*[F.lit(e) for e in FILE_EXTENSIONS])
    return docs.select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("."), F.get(exts, (F.col("doc_id") % 8).cast("int"))).alias("f"), *keep
    )


def utterance_text():
    e = F.col("event_type")
    return (
        F.when(e == "click", "smart tutor")
        .when(e == "signup", "simple tutor")
        .when(e == "error", "add docs")
        .when(e == "purchase", F.when(F.col("event_id") % 50 == 0, "exit").otherwise("help"))
        .otherwise(F.concat(F.lit("what is "), F.col("event_id").cast("string")))
    )


def utterances(events: DataFrame) -> DataFrame:
    """``(event_id, session_id, ts, text)``: one utterance per event; the
    session is the user; order is ``(ts, event_id)``."""
    return events.select("event_id", F.col("user_id").alias("session_id"), "ts", utterance_text().alias("text"))


def wiki_urls(pages: DataFrame) -> DataFrame:
    pid = F.col("page_id")
    u = F.concat(
        F.lit("https://en.wikipedia.org"),
        F.when(pid % 4 == 0, "/w/").otherwise("/wiki/"),
        F.lit("Page_"), pid.cast("string"), F.lit("%20C%2B%2B+x"),
        F.when(pid % 3 == 0, "/sub").otherwise(""),
        F.lit("?a=1#t"),
    )
    return pages.select("page_id", u.alias("u"))


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href)``: every ``href="..."`` of the page, plus an
    advertisement link on every fifth page."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), 1)
    ad = F.concat(F.lit("https://www.google.com/aclk?sa="), F.col("page_id").cast("string"))
    links = F.when(F.col("page_id") % 5 == 0, F.array_append(hrefs, ad)).otherwise(hrefs)
    return pages.select("page_id", F.posexplode(links).alias("pos", "href")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def replies(conv: DataFrame) -> DataFrame:
    """Assistant turns with a keyword suffix chosen by ``turn % 4``."""
    sfx = F.array(F.lit(" Yes."), F.lit(" No."), F.lit(" TableAgent"), F.lit(""))
    return conv.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.concat(F.col("text"), F.get(sfx, (F.col("turn") % 4).cast("int"))).alias("text")
    )


def namespaces(emb: DataFrame) -> DataFrame:
    return emb.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") % 2 == 0, "homework").otherwise("googlestuff").alias("namespace"),
        "embedding",
    )


def _turn_key(turn) -> Column:
    return F.concat_ws(":", "conv_id", turn.cast("string"))


def questions(conv: DataFrame) -> DataFrame:
    """``(qid, text)``: every user turn; ``qid`` names conversation and turn.
    Row-local."""
    return conv.where(F.col("role") == "user").select(_turn_key(F.col("turn")).alias("qid"), "text")


def answers(conv: DataFrame) -> DataFrame:
    """``(qid, answer)``: every assistant turn, under the question of the turn
    before it.  Row-local."""
    return conv.where(F.col("role") == "assistant").select(_turn_key(F.col("turn") - 1).alias("qid"), F.col("text").alias("answer"))


def upsert_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, batch_id, text)``: batch 1 ingests every document; batch 2
    re-ingests the labelled documents in compacted (shorter) form, so stale
    chunk tails must be removed by the merge."""
    one = docs.select("doc_id", F.lit(1).alias("batch_id"), "text")
    two = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", F.lit(2).alias("batch_id"), compact(F.col("text")).alias("text")
    )
    return one.unionByName(two)


def pods(conv: DataFrame) -> DataFrame:
    """``(conv_id, turn, pods)``: a solver-style result per turn -- each line
    of the turn is a pod with one sub-pod whose plaintext is null on every
    third line.  Row-local: no grouping."""
    lines = F.split(F.col("text"), "\n")
    pod = F.transform(
        lines,
        lambda ln, i: F.struct(F.array(F.struct(
            F.when(i % 3 == 2, F.lit(None).cast("string")).otherwise(ln).alias("plaintext"))).alias("subpods")),
    )
    return conv.select("conv_id", "turn", pod.alias("pods"))


def table_rows(lineitem: DataFrame) -> DataFrame:
    """``(file, ord, row)``: one CSV "file" per supplier, the header first,
    rows ordered by ``ord = (0 | 1, l_orderkey, l_linenumber, l_partkey,
    l_shipdate)`` (unique within a supplier)."""
    body = lineitem.select(
        F.col("l_suppkey").alias("file"),
        F.struct(F.lit(1).alias("h"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("ord"),
        F.concat_ws(",", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus").alias("row"),
    )
    header = lineitem.select(F.col("l_suppkey").alias("file")).distinct().select(
        "file",
        F.struct(F.lit(0).alias("h"), *[F.lit(None).cast(lineitem.schema[c].dataType).alias(c)
                                        for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")]).alias("ord"),
        F.lit(TABLE_HEADER).alias("row"),
    )
    return header.unionByName(body)
