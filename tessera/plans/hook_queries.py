"""Registered queries of the hook operators, with deterministic stand-ins for
the user's functions (encoder, model, chat, solver), over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import embed, hooks, prompts
from tessera.plans import ask as ask_plan
from tessera.sources import derived
from tessera.sources.tables import load

FOLLOW_UP = "Answer in one line."


def blank_count(texts: list[str]) -> list[int]:
    """Stands in for an encoder's token counts: blanks + 1."""
    return [t.count(" ") + 1 for t in texts]


def upper(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


def length_vectors(texts: list[str]) -> np.ndarray:
    """Stands in for a model's vectors: characters, blanks, line ends."""
    return np.array([[len(t), t.count(" "), t.count("\n")] for t in texts], dtype=np.float32)


def echo(messages: list[dict], params: dict) -> str | None:
    """Stands in for a chat model: the place of the question among the messages,
    the budget and the question; nothing to a question without a blank."""
    place, asked = next((i, m["content"]) for i, m in enumerate(messages, 1) if m["content"].startswith("Question:"))
    return None if " " not in asked else f"{place}/{params['max_tokens']}: {asked}"


def line_pods(query: str) -> list[list[str | None]]:
    """Stands in for a solver: a pod per line, empty lines without text."""
    return [[line or None] for line in query.split("\n")]


def q_hook_count_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", hooks.count_tokens_with(F.col("text"), blank_count).alias("n_tokens"))


def q_hook_transform(spark, d):
    pages = load(spark, d, "documents", "doc_id", "text")
    return pages.select("doc_id", hooks.transform_with(F.col("text"), upper).alias("text"))


def q_hook_embed(spark, d):
    """V1: a user model's vectors, one column per dimension."""
    v = embed.embed_with(load(spark, d, "documents", "doc_id", "text"), "text", length_vectors)
    return v.select("doc_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("chars", "blanks", "lines"))])


def q_hook_complete(spark, d):
    """The chat hook over the whole router prompts of every question."""
    rows = prompts.router_prompts(ask_plan.question_table(spark, d))
    table = hooks.messages_table(rows).withColumn("temperature", F.lit(0.0)).withColumn("max_tokens", F.lit(40))
    return hooks.complete_with(table, echo)


def q_hook_solve(spark, d):
    conv = load(spark, d, "conversations", "conv_id", "turn", "text")
    pods = conv.select("conv_id", "turn", hooks.solve_with(F.col("text"), line_pods).alias("pods"))
    return pods.select("conv_id", "turn", prompts.flatten_answer(F.col("pods")).alias("answer"))


def q_positional_ids(spark, d):
    """V3: documents numbered within their source."""
    docs = load(spark, d, "documents", "source", "doc_id")
    return embed.positional_ids(docs, "source", [F.col("doc_id")])


def q_command_contains(spark, d):
    """B9 in the spoken form: the first command that an utterance contains."""
    conv = load(spark, d, "conversations", "conv_id", "turn", "text")
    said = F.concat(F.col("text"), F.get(F.array(F.lit(" please EXIT"), F.lit(" Smart Tutor now"), F.lit(" help"), F.lit("")), (F.col("turn") % 4).cast("int")))
    return conv.select("conv_id", "turn", TX.command(said, "contains").alias("command"))


def q_prompt_extend(spark, d):
    """P5 + B11: each question's prompt with its cleaned answer and a follow-up,
    one row per message."""
    conv = load(spark, d, "conversations")
    qs, answers = derived.questions(conv), derived.answers(conv)
    reply = prompts.clean_reply(F.concat(F.lit(" \n"), F.col("answer"), F.lit("\n ")))
    asked = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    both = qs.join(answers, "qid").select("qid", F.posexplode(prompts.extend_prompt(asked, reply, FOLLOW_UP)).alias("pos", "m"))
    return both.select("qid", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


QUERIES = {f.__name__[2:]: f for f in (q_hook_count_tokens, q_hook_transform, q_hook_embed, q_hook_complete, q_hook_solve,
                                       q_positional_ids, q_command_contains, q_prompt_extend)}
