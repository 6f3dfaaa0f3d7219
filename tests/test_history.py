"""Conversation history in bounded parts: as a table and as streaming state."""

import uuid

import pytest

from papertrail.operators import history as H
from papertrail.session import scratch_path
from papertrail.streaming import chat as CHAT

KIND = "conv_id long, turn long, role string, text string"


def conversations():
    rows = [(c, t, "user" if t % 2 else "assistant", f"c{c} t{t}") for c in range(40) for t in range(c % 9)]
    rows += [(99, t, "user", f"hot {t}") for t in range(80)]  # a third of all turns
    return rows


def expected(rows):
    out = []
    for c, t, _, _ in rows:
        lines = [f"{r}: {x}" for cc, tt, r, x in sorted(rows, key=lambda z: (z[0] is not None, z)) if cc == c and tt < t]
        out.append((c, t, len(lines), "\n".join(lines)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_turns", [1, 7, 64])
def test_history_of_a_hot_conversation(spark, part_turns):
    rows = conversations() + [(None, t, "user", f"nobody's {t}") for t in range(9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND + ", _extra string").repartition(5)
    got = H.history_before(df, "conv_id", "turn", part_turns=part_turns)
    assert got.columns == ["conv_id", "turn", "role", "text", "_extra", "history"]
    got = sorted(((r["conv_id"], r["turn"], len(r["history"]), "\n".join(f"{m['role']}: {m['text']}" for m in r["history"]))
                  for r in got.collect()), key=repr)
    assert got == expected(rows)


def test_history_parts_are_bounded_and_no_window_runs_by_conversation(spark):
    df = spark.createDataFrame(conversations(), KIND).repartition(5)
    turns = H.numbered_turns(df, "conv_id", "turn", part_turns=10)
    parts = H.history_parts(turns)
    assert max(len(r["_own"]) for r in parts.collect()) == 10
    assert parts.filter("_conv.conv_id = 99").count() == 8
    plan = H.history_before(df, "conv_id", "turn")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "windowspecdefinition" in x]
    assert windows and all("_pid" in x for x in windows)  # slices of a partition, or the table of slices


def test_history_empty(spark):
    assert H.history_before(spark.createDataFrame([], KIND), "conv_id", "turn").collect() == []


def run(spark, src, sink, ckpt, **kw):
    stream = spark.readStream.schema(KIND).parquet(src)
    with CHAT.state_store(spark):
        q = (CHAT.chat_state(stream, **kw).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(sink).collect()), key=repr)


def test_chat_state_across_a_restart(spark):
    src, sink, ckpt = (scratch_path(spark, f"t-chat-{x}-{uuid.uuid4().hex}") for x in ("src", "sink", "ckpt"))
    rows = conversations()
    first, rest = [r for r in rows if r[1] < 30], [r for r in rows if r[1] >= 30]
    spark.createDataFrame(first, KIND).repartition(3).write.parquet(src)
    assert run(spark, src, sink, ckpt, part_turns=8) == expected(first)
    spark.createDataFrame(rest, KIND).repartition(3).write.mode("append").parquet(src)
    assert run(spark, src, sink, ckpt, part_turns=8) == expected(rows)  # parts of the first run are still there
    assert run(spark, src, sink, ckpt, part_turns=8) == expected(rows)  # nothing new, nothing twice


def test_chat_state_keeps_the_last_turns_only(spark):
    src, sink, ckpt = (scratch_path(spark, f"t-chat-{x}-{uuid.uuid4().hex}") for x in ("src", "sink", "ckpt"))
    rows = conversations()
    spark.createDataFrame(rows, KIND).write.parquet(src)
    want = [(c, t, min(n, 5), "\n".join(x.split("\n")[-5:])) for c, t, n, x in expected(rows)]
    assert run(spark, src, sink, ckpt, max_turns=5, idle_ms=3_600_000) == sorted(want, key=repr)
