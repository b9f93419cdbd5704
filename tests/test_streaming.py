"""the streamed history equals the batch history, across restarts."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import conversations as cv
from quarry.plans.queries_conversations import fx_turns
from quarry.streaming import history as sh


def test_stream_survives_restart(spark):
    base = tempfile.mkdtemp(prefix="quarry-stream-", dir="/tmp")
    src, table, ckpt = base + "/events", base + "/history", base + "/ckpt"
    turns = fx_turns(spark, SF001)
    first, second = turns.where(F.col("turn") < 3), turns.where(F.col("turn") >= 3)

    first.write.parquet(src)
    sh.stream_history(spark, src, table, ckpt, files_per_batch=3).awaitTermination()
    partial = sh.read_history(spark, table).count()

    second.write.mode("append").parquet(src)      # new events; same checkpoint
    sh.stream_history(spark, src, table, ckpt, files_per_batch=3).awaitTermination()
    got = sorted(tuple(r) for r in sh.read_history(spark, table).collect())
    want = sorted(tuple(r) for r in cv.history_rows(turns).collect())
    assert 0 < partial < len(want)
    assert got == want


def test_history_pages_match_rows(spark):
    turns = fx_turns(spark, SF001)
    rows = {}
    for r in cv.history_rows(turns).orderBy("conv_id", "position").collect():
        rows.setdefault(r["conv_id"], []).append((r["role"], r["content"]))
    for size in (1000, 3):
        pages = {}
        for r in cv.build_history(turns, page_size=size).orderBy("conv_id", "page").collect():
            assert len(r["history"]) <= size
            pages.setdefault(r["conv_id"], []).extend((m["role"], m["content"]) for m in r["history"])
        assert pages == rows


def test_out_of_order_arrival(spark):
    base = tempfile.mkdtemp(prefix="quarry-stream-", dir="/tmp")
    src, table, ckpt = base + "/events", base + "/history", base + "/ckpt"
    turns = fx_turns(spark, SF001)
    turns.where(F.col("turn") >= 2).write.parquet(src)           # later turns first
    sh.stream_history(spark, src, table, ckpt, files_per_batch=8).awaitTermination()
    turns.where(F.col("turn") < 2).write.mode("append").parquet(src)
    sh.stream_history(spark, src, table, ckpt, files_per_batch=8).awaitTermination()
    want = sorted(tuple(r) for r in cv.history_rows(turns).collect())
    assert sorted(tuple(r) for r in sh.read_history(spark, table).collect()) == want


def test_gaps_blank_inputs_and_a_hot_conversation(spark):
    rows = [(1, 0, "user", "q"), (1, 2, "assistant", "a"), (1, 5, "system", "s"), (1, 9, "user", " "), (1, 11, "assistant", "orphan"),
            (1, 12, "user", "q2"), (1, 13, "user", "q3"), (1, 20, "assistant", "a3"), (1, 20, "assistant", "a3"), (2, 0, "assistant", "hello"),
            (2, 1, "user", None), (None, 1, "user", "x"), (None, 2, "assistant", "y")]
    rows += [(3, 3 * i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(2000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    history = {(r["conv_id"], r["position"]): r["content"] for r in cv.history_rows(turns).collect()}
    assert [history[1, i] for i in range(5)] == ["q", "a", "q2", "q3", "a3"] and (1, 5) not in history
    assert history[2, 0] == "hello" and (2, 1) not in history and history[None, 1] == "y"
    assert all(history[3, i] == f"t{i}" for i in range(2000))
    replies = {(r["conv_id"], r["user_text"]): r["reply"] for r in cv.reply_or_fallback(turns).collect()}
    fence = lambda t: "```julia\n" + t + "\n```"
    assert replies[1, "q"] == fence("a") and replies[1, "q2"] == cv.APOLOGY and replies[1, "q3"] == fence("a3")
    assert replies[None, "x"] == fence("y") and replies[3, "t1998"] == fence("t1999") and (1, " ") not in replies
