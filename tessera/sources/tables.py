"""The given parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str, partitions: int = 0) -> DataFrame:
    """A table, or some of its columns.  ``partitions``: deal the raw rows to so
    many tasks (for tables in few large row groups, as the fixtures are); 0
    keeps the scan's own splits."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if columns:
        df = df.select(*columns)
    return df.repartition(partitions) if partitions else df
