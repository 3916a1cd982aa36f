"""R2: console session state over a stream of utterances.

State per session: the model in effect, whether the session has exited, the
number of rows seen and the last position ``(ts, event_id)`` applied.
``applyInPandasWithState`` keeps it between micro-batches; the Arrow batches of a
session are sorted one by one and merged, so a session's rows aren't copied into
one frame.  Output: the questions asked before the first ``exit`` with the
model in effect, the same rows ``dialog.mode_in_effect`` gives in batch.

A row that is older than the last one applied came too late: what was answered
since can't be taken back.  It changes no state and comes out flagged ``late``,
without place or model, whatever its kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.functions.text import COMMANDS

OUTPUT_SCHEMA = "session_id long, seq long, text string, model string, late boolean"
STATE_SCHEMA = "model string, exited int, seq long, ts long, event_id long"
_OUT = ["session_id", "seq", "text", "model", "late"]


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    """(ts in microseconds, event_id, text) in order."""
    ts, ids = pdf["ts"].to_numpy(), pdf["event_id"].to_numpy()
    if ts.dtype.kind == "M" and ids.dtype.kind == "i" and not np.isnat(ts).any():
        # most sessions are short: on arrays, sorting costs a fraction of a frame's
        order = np.lexsort((ids, ts))
        return zip(ts[order].astype("datetime64[us]").astype(np.int64).tolist(), ids[order].tolist(), pdf["text"].to_numpy()[order])
    pdf = pdf.sort_values(["ts", "event_id"])
    return zip(pd.to_datetime(pdf["ts"]).astype("datetime64[us]").astype("int64"), pdf["event_id"], pdf["text"])


def _step(key, pdfs: Iterator[pd.DataFrame], state):
    model, exited, seq, last = "fast", 0, 0, None
    if state.exists:
        model, exited, seq, *last = state.get
    out = []
    for ts, event_id, text in merge(*[_rows(p) for p in pdfs if not p.empty], key=lambda r: r[:2]):
        if last is not None and [ts, event_id] <= last:
            out.append((key[0], None, text, None, True))
            continue
        seq, last = seq + 1, [ts, event_id]
        if exited:
            continue
        low = (text or "").lower()
        kind = low if low in COMMANDS else "question"
        if kind == "exit":
            exited = 1
        elif kind == "smart tutor":
            model = "smart"
        elif kind == "simple tutor":
            model = "fast"
        elif kind == "question":
            out.append((key[0], seq, text, model, False))
    if last is not None:
        state.update((model, exited, seq, *last))
    if out:
        key_, seq_, text_, model_, late_ = zip(*out)
        yield pd.DataFrame(dict(zip(_OUT, (key_, pd.array(seq_, "Int64"), text_, model_, late_))))


def session_modes(utterances: DataFrame) -> DataFrame:
    """``utterances(session_id, ts, event_id, text)`` streaming DataFrame ->
    question rows with the model in effect, and late rows (append mode)."""
    return utterances.groupBy("session_id").applyInPandasWithState(
        _step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
