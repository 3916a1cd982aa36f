from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import embed, prompts
from tessera.sources import files as FS


def test_positional_ids_restart_per_source(spark):
    df = spark.createDataFrame([(s, o) for s in (1, 2) for o in (30, 10, 20)], "src long, o long")
    got = sorted((r["src"], r["o"], r["pos_id"]) for r in embed.positional_ids(df, "src", [F.col("o")]).collect())
    assert got == [(1, 10, 0), (1, 20, 1), (1, 30, 2), (2, 10, 0), (2, 20, 1), (2, 30, 2)]


def test_extend_prompt_and_clean_reply(spark):
    df = spark.createDataFrame([(' \n"an answer" \n',)], "r string")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")))
    row = df.select(
        prompts.extend_prompt(msgs, F.col("r"), "Pick one.").alias("m"),
        prompts.clean_reply(F.col("r")).alias("c"),
        TX.strip_chars(prompts.clean_reply(F.col("r")), '"').alias("s"),
    ).first()
    assert [(m["role"], m["content"]) for m in row["m"]] == [
        ("user", "q"), ("assistant", ' \n"an answer" \n'), ("user", "Pick one.")]
    assert row["c"] == '"an answer"' and row["s"] == "an answer"


def test_csv_table_keeps_values_as_written(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,code,note\n1,007,"a\nb"\n2,,NA\n')
    rows = [tuple(r) for r in FS.csv_table(spark, str(p)).collect()]
    assert rows == [("1", "007", "a\nb"), ("2", None, "NA")]
