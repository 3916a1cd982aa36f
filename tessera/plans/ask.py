"""Compositions of the operators: ingest (K1), ask (K2), web assist (K3) and
ask with fallback (K4), for whole tables of documents, pages and questions.

The chat model itself is not part of the engine; ``ask`` ends with the
prompts and their completion budget, which is what a ``complete`` hook
(``mapInPandas`` over the prompt rows) would receive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import chunking, compact, embed, prompts, retrieve, route, search_index, sections, store
from tessera.session import materialize, source_partitions
from tessera.sources import derived
from tessera.sources.tables import load

HASH_DIMS = 256
CHUNK_KEY = ["source_id", "chunk_no"]
FALLBACK_THRESHOLD = 0.2
LINKS_PER_QUESTION = 3


def ingest_documents(spark: SparkSession, sf_dir: str, namespace: str = "homework") -> DataFrame:
    """K1: documents -> word chunks -> hashed embeddings:
    ``(namespace, source_id, chunk_no, context, embedding)``."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", partitions=source_partitions(spark))
    ch = chunking.chunk_words(docs, "doc_id", "text", out="context")
    return embed.with_hashed_vector(ch, "context", HASH_DIMS).select(
        F.lit(namespace).alias("namespace"), F.col("doc_id").alias("source_id"),
        F.col("chunk_no").cast("bigint").alias("chunk_no"), "context", "embedding",
    )


def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.questions(load(spark, sf_dir, "conversations"))


def _answer(questions: DataFrame, store: DataFrame, namespace: str, model: str = "fast") -> DataFrame:
    qv = embed.hashed_dense(questions, "qid", "text", HASH_DIMS)
    # k rows per question: written once, read by the prompt and score branches.
    hits = materialize(retrieve.namespace_topk(store, qv, namespace, id_col=CHUNK_KEY, payload="context"), "hits")
    routed = route.route(questions, "qid", "text", HASH_DIMS)
    msgs = prompts.assemble_prompts(questions, hits, routed)
    per_q = msgs.groupBy("qid").agg(
        F.first("agent").alias("agent"),
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(TX.token_count(F.col("content"))).cast("bigint").alias("used"),
    )
    dim = route.agents(questions.sparkSession).select("agent", F.col("max_tokens").alias("requested"))
    b = prompts.completion_budget(per_q.join(F.broadcast(dim), "agent").withColumn("model", F.lit(model)))
    best = hits.where(F.col("rank") == 1).select("qid", F.col("score").alias("best_score"))
    return b.join(best, "qid", "left").select(
        "qid", "agent", "model", F.col("n_messages").cast("bigint").alias("n_messages"), "used", "max_tokens",
        "overflow", F.round("best_score", 6).alias("best_score"),
    )


def write_store(chunks: DataFrame, name: str = "store") -> DataFrame:
    """A8 for a fresh store: write the namespace-partitioned chunk table to
    the shared scratch folder and read it back (queries prune on
    ``namespace``)."""
    from tessera.session import work_dir

    spark = chunks.sparkSession
    path = work_dir(spark, name)
    chunks.write.partitionBy("namespace").parquet(path)
    if not store.versions_exist(spark, path):
        # an empty partitioned write leaves no data file to read a schema from
        return spark.createDataFrame([], chunks.schema)
    return spark.read.parquet(path)


def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: every question's routed profile, prompt size and completion budget."""
    return _answer(question_table(spark, sf_dir), write_store(ingest_documents(spark, sf_dir)), "homework")


def web_namespace(spark: SparkSession, sf_dir: str, questions: DataFrame, namespace: str = "googlestuff") -> DataFrame:
    """K3: pages found for the questions (lexical link search, 3 per
    question), canonical URL, visible text (wiki pages by section), 4,000
    character slices, compaction, embedding.  Each page is processed once
    however many questions link to it."""
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html", partitions=source_partitions(spark))
    url = pages.select("page_id", TX.canonical_url("url").alias("url"), "html")
    # Encyclopedia pages keep their title and surviving sections (C5-C9); others the visible text (B1)
    wiki = F.coalesce(TX.is_wikipedia(F.col("url")), F.lit(False))
    split = url.where(wiki).select("page_id", TX.wiki_title("url").alias("title"), TX.html_to_text(TX.headings_as_lines("html")).alias("text"))
    sectioned = sections.assemble_sections(split.select("page_id", "text"), "page_id", "text").join(split.select("page_id", "title"), "page_id")
    plain = url.where(~wiki).select("page_id", F.lit(None).cast("string").alias("title"), TX.html_to_text("html").alias("text"))
    text = plain.unionByName(sectioned.select("page_id", "title", "text")).where(F.coalesce(F.col("text"), F.lit("")) != "")
    text = materialize(text, "page-text")  # indexed, and read again for the pages that are found
    index = search_index.build(text, "page_id", "text")
    qterms = materialize(search_index.search_terms(index, questions, "qid", "text"), "question-terms")
    links = search_index.bm25_topk(index, qterms, k=LINKS_PER_QUESTION)
    used_pages = materialize(links.select(F.col("id").alias("page_id")).distinct(), "linked-pages")
    used = text.join(used_pages, "page_id", "left_semi")
    sl = chunking.chunk_fixed(used, "page_id", "text").join(used.select("page_id", "title"), "page_id")
    sl = sl.select("title", "page_id", "slice_no", compact.compact(F.col("slice")).alias("context")).where(F.col("context") != "")
    return embed.with_hashed_vector(sl, "context", HASH_DIMS).select(
        F.lit(namespace).alias("namespace"), F.col("page_id").alias("source_id"),
        F.col("slice_no").cast("bigint").alias("chunk_no"), "title", "context", "embedding",
    )


def web_assist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 end to end: answers for every question from the web namespace."""
    qs = question_table(spark, sf_dir)
    return _answer(qs, write_store(web_namespace(spark, sf_dir, qs)), "googlestuff")


def ask_with_fallback(spark: SparkSession, sf_dir: str, threshold: float = FALLBACK_THRESHOLD,
                      verdicts: DataFrame | None = None) -> DataFrame:
    """K4: questions that the documents don't satisfy are answered again from the
    web namespace; ``tier`` 1 or 2.  Satisfied: the best context scores at least
    ``threshold``, or, where ``verdicts(qid, verdict)`` of a judge (B7) are given,
    the verdict is true."""
    qs = question_table(spark, sf_dir)
    first = materialize(_answer(qs, write_store(ingest_documents(spark, sf_dir)), "homework"), "first-answers")
    if verdicts is None:
        ok = first.where(F.col("best_score") >= threshold)
    else:
        ok = first.join(verdicts.where("verdict"), "qid", "left_semi")
    rest = materialize(qs.join(ok.select("qid"), "qid", "left_anti"), "refused")
    second = _answer(rest, write_store(web_namespace(spark, sf_dir, rest)), "googlestuff")
    return ok.withColumn("tier", F.lit(1).cast("bigint")).unionByName(second.withColumn("tier", F.lit(2).cast("bigint")))
