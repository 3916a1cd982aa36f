"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is fully executed (written to a no-op sink), after one warm-up
query that starts the JVM and Python workers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.session import get_session, scratch  # noqa: E402

HEADLINE = [
    "chunk_words",
    "html_to_text",
    "token_count",
    "section_assemble",
    "embed_hash",
    "chunk_table_rows",
    "vector_topk",
    "lexical_topk",
    "route_questions",
    "mode_in_effect",
    "upsert_latest",
    "ask",
    "ask_with_fallback",
    "folder_ingest",
    "stream_ingest",
]


def run(df) -> int:
    df.write.format("noop").mode("overwrite").save()
    return 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    # the fixtures are files of one row group: deal their rows to several tasks per core
    spark.conf.set("tessera.source.partitions", str(4 * int(cpus)))
    # warm-up: JVM, codegen caches, and the Python workers (Arrow, NumPy
    # imports) that the Arrow-batched operators reuse afterwards
    run(QUERIES["token_count"](spark, sf_dir))
    run(QUERIES["vector_topk"](spark, sf_dir))
    run(QUERIES["embed_hash"](spark, sf_dir))
    times = {}
    for name in only:
        with scratch(spark):
            t0 = time.time()
            run(QUERIES[name](spark, sf_dir))
            times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
