"""Console dialog state over an utterance log.

The reference keeps one mutable ``model`` while reading lines: "smart tutor"
and "simple tutor" switch the model for later questions, "exit" ends the
session.  Over a table of utterances this is a forward fill and a running
maximum per session, computed with ``keyed_running`` so one very long
session is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import command
from tessera.operators.scan import keyed_running

DEFAULT_MODEL = "fast"


def mode_in_effect(utter: DataFrame, session_col: str, order: list, text_col: str = "text",
                   match: str = "exact", seq_col: str | None = "seq") -> DataFrame:
    """Questions asked before the session's first ``exit``, with the model in
    effect: ``(session, seq, text, model)``.  ``order`` must be unique
    within a session; ``seq`` (1-based position) is computed in the same
    pass when ``seq_col`` is given."""
    kind = command(F.col(text_col), match)
    staged = utter.withColumn("kind", kind).withColumn(
        "_m", F.when(F.col("kind") == "smart tutor", "smart").when(F.col("kind") == "simple tutor", "fast")
    ).withColumn("_x", (F.col("kind") == "exit").cast("int"))
    aggs = [("_model", "last", "_m"), ("_exited", "max", "_x")]
    if seq_col:
        aggs.insert(0, (seq_col, "count", None))
    run = keyed_running(staged, session_col, order, aggs)
    keep = [session_col] + ([seq_col] if seq_col else []) + [text_col]
    return run.where((F.col("kind") == "question") & (F.col("_exited") == 0)).select(
        *keep, F.coalesce(F.col("_model"), F.lit(DEFAULT_MODEL)).alias("model")
    )
