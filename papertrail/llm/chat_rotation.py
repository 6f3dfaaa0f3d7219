"""Multi-party perspective rotation of conversations, DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users; spans mark the
text that bears loss: the assistant's turns with their end mark.  The
system role is context, never a participant.

Turns are numbered by (turn, role, text) with a distributed prefix scan,
so a conversation with a third of all turns is not gathered in one task.
A rendering comes in parts of ``part_turns`` turns; the parts of a
(conversation, speaker), joined in order, are the whole dialogue.  Span
offsets are characters within the part.

Defined cases: a null text is an empty turn; a null role is the speaker
``unknown``; null turns come last; rows that repeat (turn, role, text) are
turns each; a null conversation id is one conversation; a conversation of
system turns alone has no rendering; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.operators.scan import prefix_scan

PART_TURNS = 64
# fixed values: the marks of the chat template
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _rendered(turn: Column, speaker: Column) -> Column:
    """struct(head, body, mine) of a turn as seen by ``speaker``."""
    mine = turn["who"].eqNullSafe(speaker) & ~turn["system"]
    head = F.when(turn["system"], F.lit(f"{BEGIN}system\n")).when(mine, F.lit(f"{BEGIN}assistant\n")) \
        .otherwise(F.concat(F.lit(f"{BEGIN}user name="), turn["who"], F.lit("\n")))
    return F.struct(head.alias("head"), F.concat(turn["text"], F.lit(END)).alias("body"), mine.alias("mine"))


def _spans(turns: Column) -> Column:
    """[from, to) of the loss-bearing bodies, in characters."""
    none = F.array().cast("array<struct<from:int,to:int>>")
    end = F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), lambda a, t: F.struct(
        (a["at"] + F.length(t["head"]) + F.length(t["body"]) + 1).alias("at"),
        F.when(t["mine"], F.concat(a["spans"], F.array(F.struct(
            (a["at"] + F.length(t["head"])).alias("from"),
            (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("to"))))).otherwise(a["spans"]).alias("spans")))
    return end["spans"]


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, spans."""
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    t = conversations.select(
        F.col(conv_col).isNull().alias("no_conv"), F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("conv"),
        F.col(turn_col).isNull().alias("no_turn"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        role.alias("who"), (role == "system").alias("system"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    numbered = prefix_scan(t, ["no_conv", "conv"], ["no_turn", "turn", "who", "text"],
                           {"at": ("sum", F.lit(1))}, inclusive=False)
    parts = numbered.groupBy("no_conv", "conv", F.floor(F.col("at") / part_turns).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("at", "who", "system", "text"))).alias("turns"))  # part_turns at most
    speakers = t.filter("not system").select("no_conv", "conv", F.col("who").alias("speaker")).distinct()
    seen = parts.join(speakers, ["no_conv", "conv"])
    turns = F.transform("turns", lambda x: _rendered(x, F.col("speaker")))
    seen = seen.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "speaker", "part", turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return seen.select("conv_id", "speaker", "part", F.size("turns").alias("n_turns"), text.alias("text"),
                       _spans(F.col("turns")).alias("spans"))
