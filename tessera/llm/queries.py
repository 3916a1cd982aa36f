"""The queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import licenses

    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import huffman

    path = work_dir(spark, "id-files")
    huffman.write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return huffman.digest(spark, path)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import rules

    return rules.quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import repeats

    return repeats.digest(_table(spark, sf_dir, "documents"), length=400)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import warc

    path = work_dir(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.histories(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import topk

    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs, fold = _table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~fold)
    return toxicity.score(docs, model).select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import sharding

    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import scan_search

    return scan_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_token_files, op3_quality_rules, op4_pack, op5_repeats, op6_mix, op7_warc, op8_simhash, op9_topk, op10_toxicity,
    op11_shards, op12_hard_negatives, op13_lexical_scan)}

SQL: dict[str, str] = {
    "op3_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM d
        ), windows AS (
            SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2
        ), twice AS (
            SELECT r, i, count(*) OVER (PARTITION BY r, words[i:i + 2]) AS n FROM windows
        ), covered AS (
            SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r
        ), f AS (
            SELECT d.doc_id, d.t, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
            FROM d JOIN w USING (r) LEFT JOIN covered USING (r)
        ), b AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines
                    OR 2 * length(regexp_replace(t, '\PL', '', 'g')) < word_chars
                    OR 2 * length(regexp_replace(t, '\P{Lu}', '', 'g')) > word_chars
                    OR word_chars > 60 * n_words
                    OR 10 * (1 + len(regexp_extract_all(t, '(?:\.\.\.|…)(?:\n|\z)'))) > 10 + 5 * n_lines) AS kept
        FROM b""",
    "op6_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) % 256 AS salt
            FROM documents
        ), s AS (
            SELECT source, sum(size) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM d GROUP BY source
        ), o AS (
            SELECT *, 2 * source_size / weight AS ratio, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM s
        ), l AS (  -- the level at which the first k - 1 sources are full and the others share the rest
            SELECT a.k, a.ratio, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(2 * b.source_size) FILTER (b.k < a.k), 0))
                   / sum(b.weight) FILTER (b.k >= a.k) AS level
            FROM o a, o b GROUP BY a.k, a.ratio
        ), level AS (
            SELECT arg_min(level, k) AS level FROM l WHERE ratio > level
        ), t AS (
            SELECT source, CAST(source_size AS BIGINT) AS source_size,
                   CASE WHEN ratio > level THEN weight * level ELSE CAST(2 * source_size AS DOUBLE) END AS target,
                   CAST('0x' || substr(md5('mix/' || coalesce(source, chr(0))), 1, 8) AS UBIGINT) % 1048576 / 1048576 AS start
            FROM o LEFT JOIN level ON true
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(8 * (ln(size + 1) / ln(2))), salt, size, doc_id NULLS FIRST) AS place FROM d
        ), e AS (
            SELECT p.*, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each
            FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * least(2, floor(place * each + start) - floor((place - 1) * each + start)) AS BIGINT) AS taken
        FROM e""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), r AS (
            SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
                   min(page_id) OVER (PARTITION BY sha256(html)) AS first
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
        FROM r""",
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM v a JOIN v c ON len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n
            FROM s WHERE same AND vec_id <> anchor_id QUALIFY n <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, n ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
               s.vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
    "op13_lexical_scan": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ), g AS (
            SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS size FROM d
        ), i AS (
            SELECT row_number() OVER () AS i, item_id,
                   list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark
        ), it AS (
            SELECT i, item_id, unnest(t) AS term FROM i
        ), p AS (
            SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
            WHERE term IN (SELECT term FROM it) GROUP BY r, doc_id, n, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs
        ), s AS (
            SELECT i, item_id, r, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * n * docs // size)))) AS BIGINT) AS score
            FROM p JOIN w USING (term) JOIN it USING (term), g GROUP BY i, item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
