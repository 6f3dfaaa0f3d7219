"""Earlier turns of conversations (W4) without one task per conversation.

Turns get their number by a prefix scan and lie in parts of ``part_turns``.
A part is one bounded row; it is copied to the later parts of its
conversation, which join those copies up to all that went before; a turn then
meets its part, one of ``part_turns`` rows with that key.  No key holds more rows
than a part has turns or a conversation has parts, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.operators.scan import prefix_scan
from papertrail.operators.sizing import checked_broadcast

PART_TURNS = 64


def numbered_turns(df: DataFrame, conv: str, turn: str, role: str = "role", text: str = "text",
                   part_turns: int = PART_TURNS) -> DataFrame:
    """``df`` with ``_conv`` (the conversation, null being one like the others),
    ``_n`` (earlier turns) and ``_part``."""
    n = prefix_scan(df.withColumn("_conv", F.struct(conv)), ["_conv"], [turn, role, text], {"_n": ("sum", F.lit(1), False)})
    return n.withColumn("_part", F.floor(F.col("_n") / part_turns).cast("int"))


def history_parts(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """One row per part: ``_conv``, ``_part``, ``_own`` (its turns in order) and
    ``_before`` (all turns of the conversation before the part)."""
    parts = turns.groupBy("_conv", "_part").agg(
        F.array_sort(F.collect_list(F.struct("_n", F.col(role).alias("role"), F.col(text).alias("text")))).alias("_own"))
    last = parts.groupBy("_conv").agg(F.max("_part").alias("_last")).filter("_last > 0")
    earlier = parts.join(checked_broadcast(last, 1_000_000), "_conv").filter("_part < _last").select(
        "_conv", F.col("_part").alias("_from"), "_own", F.explode(F.sequence(F.col("_part") + 1, F.col("_last"))).alias("_part"))
    ordered = F.array_sort(F.collect_list(F.struct("_from", "_own")))
    before = earlier.groupBy("_conv", "_part").agg(F.flatten(F.transform(ordered, lambda p: p["_own"])).alias("_before"))
    return parts.join(before, ["_conv", "_part"], "left")


def history_before(df: DataFrame, conv: str, turn: str, role: str = "role", text: str = "text",
                   part_turns: int = PART_TURNS) -> DataFrame:
    """``df`` with ``history``: all earlier turns of the conversation, in order.
    Equal turn numbers are ordered by role and text."""
    turns = numbered_turns(df, conv, turn, role, text, part_turns)
    out = turns.join(history_parts(turns, role, text), ["_conv", "_part"])
    own = F.filter("_own", lambda x: x["_n"] < F.col("_n"))
    whole = F.when(F.col("_before").isNull(), own).otherwise(F.concat("_before", own))
    return out.select(*df.columns, F.transform(whole, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("history"))
