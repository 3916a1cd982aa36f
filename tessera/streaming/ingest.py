"""Incremental ingestion into the chunk store with Structured
Streaming.

Each micro-batch of new documents (a parquet drop, or files from a
``binaryFile`` stream) is reduced to one version per source, chunked, embedded
and added to the store as a layer in ``foreachBatch``, in proportion to the batch;
layers of like size are put into one now and then.  The version's manifest records the
stream and its epoch, so a replayed epoch changes nothing, several streams can
feed one store, and a new checkpoint on an old store goes on from its newest
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, embed, store
from tessera.operators.embed import DEFAULT_DIMS


def chunk_batch(batch: DataFrame, namespace: str, dims: int, with_vectors: bool) -> DataFrame:
    """Documents ``(source_id, text)`` of one micro-batch to store rows."""
    c = chunking.word_chunks(batch, "text", keep=["source_id"], out="context").select(
        F.lit(namespace).alias("namespace"), "source_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "context")
    return embed.with_hashed_vector(c, "context", dims) if with_vectors else c


def make_batch_writer(store_root: str, namespace: str = "homework", mode: str = "by_source",
                      dims: int = DEFAULT_DIMS, with_vectors: bool = True, stream: str = "", order: str | None = None):
    """``stream`` names the feed in the manifest; ``order``: the column that tells
    which of several versions of a source in one batch is the newest."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        docs = store.newest_documents(batch, ["source_id"], order)
        sources = batch.select(F.lit(namespace).alias("namespace"), "source_id")
        store.upsert(batch.sparkSession, store_root, chunk_batch(docs, namespace, dims, with_vectors), mode, sources,
                     f"{namespace}/{stream}", epoch_id)
        store.compact(batch.sparkSession, store_root)

    return write


def run_ingest_stream(docs_stream: DataFrame, store_root: str, checkpoint: str, namespace: str = "homework",
                      mode: str = "by_source", with_vectors: bool = True, order: str | None = None) -> None:
    """Process everything available now (``trigger(availableNow=True)``) and
    return when done; call again after new drops arrive.  The checkpoint is the
    feed's name: epochs count within it."""
    q = (
        docs_stream.writeStream.foreachBatch(
            make_batch_writer(store_root, namespace, mode, with_vectors=with_vectors, stream=checkpoint, order=order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def latest_version(spark: SparkSession, store_root: str) -> DataFrame:
    return store.read_store(spark, store_root)
