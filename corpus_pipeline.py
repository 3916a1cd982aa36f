"""The training-data pipeline: documents to packed sequences in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, packing, repeats, rules, simhash
from tessera.session import materialize, ship_package

#: Bytes of a passage that is removed where it repeats: five a word, for passages of 50 words.
PASSAGE = 250
#: Bytes whose hash chooses the places that are compared, a quarter: no matter for what is removed, but for how many there are.
GRAM = 64


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    ship_package(spark)
    return simhash.deduplicate(docs, shingle=3, bits=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE`` bytes or more that occur at another place too go from the texts."""
    ship_package(spark)
    return repeats.strip(docs, length=PASSAGE, gram=GRAM)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its place in a sequence of at most 4096 tokens."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express shingle fingerprints or tokenizers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
