from pyspark.sql import functions as F

from tessera.operators import hooks, prompts


def test_count_and_transform_hooks(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id long, t string")
    out = df.select(
        "id",
        hooks.count_tokens_with(F.col("t"), lambda xs: [len(x.split()) for x in xs]).alias("n"),
        hooks.transform_with(F.col("t"), lambda xs: [x.upper() for x in xs]).alias("u"),
    ).orderBy("id").collect()
    assert [(r["n"], r["u"]) for r in out] == [(3, "A B C"), (0, "")]


def test_complete_hook_over_prompt_rows(spark):
    rows = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q1"), (2, 0, "system", "s"), (2, 1, "user", "none")],
        "qid long, pos bigint, role string, content string",
    )
    table = hooks.messages_table(rows).withColumn("temperature", F.lit(0.5)).withColumn("max_tokens", F.lit(10))

    def fake(msgs, params):
        last = msgs[-1]["content"]
        return None if last == "none" else f"{last}:{params['max_tokens']}:{len(msgs)}"

    got = {r["qid"]: r["reply"] for r in hooks.complete_with(table, fake).collect()}
    assert got == {1: "q1:10:2", 2: None}


def test_solve_hook_then_flatten(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, q string")

    def solver(q):
        return [["a", None], [None]] if q == "x" else [[None]]

    pods = df.select("id", hooks.solve_with(F.col("q"), solver).alias("pods"))
    got = {r["id"]: r["a"] for r in pods.select("id", prompts.flatten_answer(F.col("pods")).alias("a")).collect()}
    assert got == {1: "a", 2: None}


def test_embed_hook_factory_once_per_task(spark):
    import numpy as np

    from tessera.operators import embed

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, t string")
    got = {r["id"]: list(r["embedding"]) for r in embed.embed_with(df, "t", factory, factory=True).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0]}


def test_chat_hook_gets_whole_router_prompts(spark, monkeypatch):
    from tessera.plans import hook_queries

    monkeypatch.setattr(hook_queries, "echo", lambda messages, params: "\n--\n".join(m["content"] for m in messages))
    got = [r["reply"].split("\n--\n") for r in hook_queries.q_hook_complete(spark, "/root/testdata/sf0.001").collect()]
    assert got and {len(m) for m in got} == {4}
    assert {m[3] for m in got} == {prompts.AGENT_LIST_TEXT} and all(m[2].startswith("Question:") for m in got)
