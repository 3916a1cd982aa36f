from tessera.operators import store
from tessera.streaming import ingest as SI


def _rows(df):
    return sorted((r["source_id"], r["chunk_no"], r["batch_id"], r["context"]) for r in df.collect())


def test_batch_writer_replay_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "store")
    write = SI.make_batch_writer(root, with_vectors=False)
    b0 = spark.createDataFrame([(1, "one two three"), (2, "alpha beta")], "source_id long, text string")
    b1 = spark.createDataFrame([(1, "new")], "source_id long, text string")
    write(b0, 0)
    write(b1, 1)
    first = _rows(SI.latest_version(spark, root))
    write(b1, 1)  # the epoch is replayed after a failure
    assert store.versions(spark, root) == [1, 2] and _rows(SI.latest_version(spark, root)) == first
    assert first == [(1, 0, 2, "new"), (2, 0, 1, "alpha beta")]


def test_two_feeds_and_a_new_checkpoint_share_a_store(spark, tmp_path):
    root = str(tmp_path / "store")
    doc = lambda *rows: spark.createDataFrame(rows, "source_id long, text string")
    SI.make_batch_writer(root, with_vectors=False, stream="a")(doc((1, "home")), 0)
    SI.make_batch_writer(root, "googlestuff", with_vectors=False, stream="b")(doc((1, "web")), 0)
    SI.make_batch_writer(root, with_vectors=False, stream="c")(doc((2, "later")), 0)  # a new checkpoint, epoch 0 again
    got = sorted((r["namespace"], r["source_id"], r["context"]) for r in SI.latest_version(spark, root).collect())
    assert got == [("googlestuff", 1, "web"), ("homework", 1, "home"), ("homework", 2, "later")]


def test_two_versions_in_one_batch_are_not_mixed(spark, tmp_path):
    root = str(tmp_path / "store")
    long = " ".join(["old"] * 600)
    batch = spark.createDataFrame([(1, long, 1), (1, "new", 2)], "source_id long, text string, at int")
    SI.make_batch_writer(root, with_vectors=False, order="at")(batch, 0)
    assert [r[1:] for r in _rows(SI.latest_version(spark, root))] == [(0, 1, "new")]


def test_late_rows_are_flagged_and_change_nothing(spark, tmp_path):
    import datetime as dt

    from tessera.streaming import session_state as SS

    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, session_id long, ts timestamp, text string"
    row = lambda i, s, text: (i, 1, t0 + dt.timedelta(seconds=s), text)
    src, ck, out = str(tmp_path / "src"), str(tmp_path / "ck"), str(tmp_path / "out")
    for part in ([row(5, 5, "first")], [row(0, 0, "smart tutor"), row(1, 1, "old question"), row(6, 6, "second")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        SS.session_modes(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=repr)
    assert got == sorted([(1, 1, "first", "fast", False), (1, 2, "second", "fast", False), (1, None, "smart tutor", None, True),
                          (1, None, "old question", None, True)], key=repr)


def test_session_state_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from tessera.operators import dialog
    from tessera.streaming import session_state as SS

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, s, t0 + dt.timedelta(seconds=i), txt) for i, (s, txt) in enumerate([
        (1, "what"), (1, "smart tutor"), (2, "q"), (1, "why"), (1, "exit"), (1, "after"), (2, "simple tutor"), (2, "r")])]
    schema = "event_id long, session_id long, ts timestamp, text string"
    batch = spark.createDataFrame(rows, schema)
    exp = sorted(tuple(r) for r in dialog.mode_in_effect(batch, "session_id", [F.col("ts"), F.col("event_id")]).collect())
    src, ck, out = str(tmp_path / "src"), str(tmp_path / "ck"), str(tmp_path / "out")
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        q = (SS.session_modes(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ck).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("session_id", "seq", "text", "model").collect())
    assert got == exp == [(1, 1, "what", "fast"), (1, 3, "why", "smart"), (2, 1, "q", "fast"), (2, 3, "r", "fast")]


def test_a_step_sorts_arrays_not_frames(monkeypatch):
    """Most sessions are short, where a frame's own sort costs more than the rest of the step."""
    import pandas as pd

    from tessera.streaming import session_state

    class State:
        exists, kept = False, None

        def update(self, x):
            self.kept = x

    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    ts = pd.to_datetime(["2024-01-01 00:00:02", "2024-01-01 00:00:01", "2024-01-01 00:00:01"])
    rows = pd.DataFrame({"session_id": [5] * 3, "ts": ts, "event_id": [1, 3, 2], "text": ["c", "Smart Tutor", None]})
    state = State()
    out = pd.concat(session_state._step((5,), iter([rows]), state))
    assert [tuple(r) for r in out[["session_id", "seq", "model", "late"]].itertuples(index=False)] == [(5, 1, "fast", False), (5, 3, "smart", False)]
    assert state.kept[:3] == ("smart", 0, 3)
