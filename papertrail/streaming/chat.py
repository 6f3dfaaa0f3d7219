"""Conversation history as streaming state.

The state of a conversation is a map of parts, each the turns whose numbers
share ``turn // part_turns``: a micro-batch reads the parts it needs one at a time
and writes only those that got turns, never a row with the whole history.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PART_TURNS = 64
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # all state stores of an executor share this much, however many partitions it holds
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # with a time to live every batch asks for another, and a run over what is available would not end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state where map state is supported, and
    run no batches without data."""
    was = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ChatHistory(StatefulProcessor):
    """For each incoming turn all turns of lower number that have arrived, those
    of its own micro-batch included."""

    def __init__(self, columns: tuple, part_turns: int, max_turns: int | None, ttl_ms: int | None):
        self.columns, self.part_turns, self.max_turns, self.ttl_ms = columns, part_turns, max_turns, ttl_ms

    def init(self, handle) -> None:
        self.parts = handle.getMapState("parts", "part long", "turns array<long>, lines array<string>", self.ttl_ms)

    def _add(self, rows) -> list[int]:
        """Put rows into their parts; returns their turn numbers."""
        _, turn, role, text = self.columns
        came: list[int] = []
        for pdf in rows:
            for part, group in pdf.groupby(pdf[turn] // self.part_turns):
                key = (int(part),)
                turns, lines = map(list, self.parts.getValue(key)) if self.parts.containsKey(key) else ([], [])
                turns += [int(t) for t in group[turn]]
                lines += [f"{r}: {x}" for r, x in zip(group[role], group[text])]
                self.parts.updateValue(key, (turns, lines))
                came += turns[len(turns) - len(group):]
        return sorted(came)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        conv, turn, *_ = self.columns
        came = deque(self._add(rows))
        before: deque = deque(maxlen=self.max_turns)
        for part in sorted(k[0] for k in self.parts.keys()):
            out = []
            turns, lines = self.parts.getValue((part,))
            held = sorted(zip(map(int, turns), lines), key=lambda x: x[0])
            at = 0
            while came and came[0] // self.part_turns == part:
                t = came.popleft()
                while held[at][0] < t:
                    before.append(held[at][1])
                    at += 1
                out.append((key[0], t, len(before), "\n".join(before)))
            before.extend(x for _, x in held[at:])
            if out:
                yield pd.DataFrame(out, columns=[conv, turn, "n_history", "history_text"])
            if not came:
                return

    def close(self) -> None:
        pass


def chat_state(stream: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               max_turns: int | None = None, idle_ms: int | None = None, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per incoming turn (a number): ``conv``, ``turn``, n_history and
    history_text, its earlier turns or the last ``max_turns`` of them.

    With ``idle_ms`` a part that got no turn for so long is forgotten.  The query
    must be started inside :func:`state_store`, or in a session that keeps
    streaming state in RocksDB.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    processor = ChatHistory((conv, turn, role, text), part_turns, max_turns, idle_ms)
    return stream.select(conv, turn, role, text).groupBy(conv).transformWithStateInPandas(
        processor, f"`{conv}` {kinds[conv]}, `{turn}` {kinds[turn]}, n_history long, history_text string",
        "Append", "ProcessingTime" if idle_ms else "None")
