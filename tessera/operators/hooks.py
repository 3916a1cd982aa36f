"""User hooks for the remote or codec steps the engine does not ship
(survey §2.12): exact token counts, model-based text transforms, chat
completion and a maths solver.  Each runs the user's function in Arrow
batches on the executors; data never goes through the driver.

Decoding files (``sources.files.decode_with``) and embedding
(``operators.embed.embed_with``) are the other two hooks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PODS_TYPE = T.ArrayType(T.StructType([
    T.StructField("subpods", T.ArrayType(T.StructType([T.StructField("plaintext", T.StringType())]))),
]))


def count_tokens_with(text: Column, fn: Callable[[list[str]], list[int]]) -> Column:
    """T1 hook: exact token counts from a user encoder, ``fn(texts) -> counts``."""

    @F.pandas_udf(T.LongType())
    def _count(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.fillna("").tolist()), dtype="int64")

    return _count(text)


def transform_with(text: Column, fn: Callable[[list[str]], list[str]]) -> Column:
    """C10 hook: model-based text transform, ``fn(texts) -> texts``."""

    @F.pandas_udf(T.StringType())
    def _tx(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.fillna("").tolist()), dtype="object")

    return _tx(text)


def complete_with(prompts: DataFrame, fn: Callable[[list[dict], dict], str | None], key: str = "qid",
                  messages_col: str = "messages", params: tuple[str, ...] = ("temperature", "max_tokens"),
                  out: str = "reply") -> DataFrame:
    """Chat hook over a prompts table: one call per prompt with its messages
    (``list[{"role", "content"}]``) and parameters; a null reply stays null.
    Returns ``(key, reply)``."""
    schema = T.StructType([prompts.schema[key], T.StructField(out, T.StringType())])
    cols = [key, messages_col, *params]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            for rec in pdf.itertuples(index=False):
                msgs = [{"role": m["role"], "content": m["content"]} for m in getattr(rec, messages_col)]
                replies.append(fn(msgs, {p: getattr(rec, p) for p in params}))
            yield pd.DataFrame({key: pdf[key], out: replies})

    return prompts.select(*cols).mapInPandas(run, schema)


def messages_table(rows: DataFrame, key: str = "qid") -> DataFrame:
    """Rows ``(key, pos, role, content)`` back to ``(key, messages)``; one
    prompt's messages are few (contexts are top-k)."""
    return rows.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "content"))),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )


def solve_with(text: Column, fn: Callable[[str], list[list[str | None]]]) -> Column:
    """Maths hook: ``fn(query) -> pods`` (each pod a list of sub-pod
    plaintexts, ``None`` allowed); feed the result to ``flatten_answer``."""

    @F.pandas_udf(PODS_TYPE)
    def _solve(s: pd.Series) -> pd.Series:
        out = []
        for q in s.fillna(""):
            pods = fn(q) or []
            out.append([{"subpods": [{"plaintext": p} for p in pod]} for pod in pods])
        return pd.Series(out, dtype="object")

    return _solve(text)
