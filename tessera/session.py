"""Session construction and the shared scratch location.

Scratch tables (lineage cuts, streaming checkpoints, store versions) always go
under the folder the cluster names in ``spark.checkpoint.dir``.  Only when the
session has none (local tests, the bench) is a private folder created and
registered as the checkpoint directory.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable by the Python workers (``addPyFile`` of a
    zip of the package, once per SparkContext), so Arrow/pandas functions
    defined here unpickle on executors whatever their working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="tessera-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _checkpoint_base(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base:
        return base
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", sc.master):
            # a folder of one machine would hold only that machine's part of a table
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # local runs and tests: a private folder, registered
        base = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and ``path`` as it wants it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_scratch: list[list[str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's checkpoint directory."""
    base = _checkpoint_base(spark)
    path = os.path.join(base, "tessera", f"{name}-{uuid.uuid4().hex[:12]}")
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Scratch folders made inside are deleted at the end: use up a query's
    result (write or collect it) within the block."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            fs, p = file_system(spark, path)
            fs.delete(p, True)


#: For tables whose rows are blocks of many rows: a scan decodes a row group at once (up to 4,096
#: rows, and its encoded bytes say little of what they decode to), so a group has few rows.
BLOCK_ROWS = {"parquet.block.row.count.limit": "2", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
SEGMENT_ROWS = BLOCK_ROWS | {"parquet.block.row.count.limit": "32"}  # of some 100 kB each


def materialize(df: DataFrame, name: str = "stage", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage with a reliable copy (survives executor loss), unlike
    ``localCheckpoint``.  ``options``: of the Parquet writer (``BLOCK_ROWS``).
    """
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return df.sparkSession.read.parquet(path)


def source_partitions(spark: SparkSession) -> int:
    """``tessera.source.partitions``: tasks that a source's rows are dealt to
    before heavy row-local work; 0 (the default) keeps the scan's own splits."""
    return int(spark.conf.get("tessera.source.partitions", "0"))
