"""Relational chat formatting: collected turn structs are sorted, adjacent ones of one role merged, and all concatenated with Spark expressions only.

A message is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line end. Adjacent turns of one role are one message, their texts joined by
``<|im_next|>``. In roles and texts ``<``, any backslashes and ``|`` get one backslash more, so no text can hold a control string, and
taking one backslash away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import core
from .secrets import running_before

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation; spans are (start, end) in code points of the texts of ``loss_role``.

    Turns are ordered by number, then role and text; equal ones all stay. A null role or text is empty, a null number comes first, null
    conversation ids are one conversation, other columns are left out, an empty table gives no rows.
    """
    rows = core(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # nulls first
    # each turn escaped, and whether it opens a message
    opens = lambda t, i: (i == 0) | (t["role"] != F.get("turns", i - 1)["role"])
    marked = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), escape(t["text"]).alias("shown"), opens(t, i).alias("opens")))
    chats = chats.select("conv_id", marked.alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["opens"])
    chats = chats.select("conv_id", "turns", starts.alias("starts"))
    # messages: runs of turns of one role, merged
    opening = lambda role: F.concat(F.lit(START), escape(role), F.lit(SEP))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("turns")))
    merged = lambda a, b: F.array_join(F.transform(F.slice("turns", a + 1, b - a), lambda t: t["shown"]), NEXT)
    messages = F.zip_with("starts", ends, lambda a, b: F.concat(opening(F.get("turns", a)["role"]), merged(a, b), F.lit(END)))
    # where each text stands: behind what comes before it and the control strings in front of it
    head = F.transform("turns", lambda t, i: F.when(t["opens"], F.length(opening(t["role"])) + F.when(i == 0, 0).otherwise(len(END))).otherwise(len(NEXT)))
    lengths = F.zip_with(head, F.col("turns"), lambda h, t: F.struct(h.alias("head"), F.length(t["shown"]).alias("length"), t["role"].alias("role")))
    chats = chats.select("conv_id", F.array_join(messages, "").alias("formatted"), lengths.alias("lengths"))
    before = running_before(F.transform("lengths", lambda x: x["head"] + x["length"]))
    places = F.zip_with("lengths", before, lambda x, b: F.struct(x["role"].alias("role"), (b + x["head"]).cast("long").alias("start"),
                                                               (b + x["head"] + x["length"]).cast("long").alias("end")))
    spans = F.transform(F.filter(places, lambda x: x["role"] == loss_role), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of the turns that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        parts = F.split(F.substring_index(block, END, 1), r"<\|im_sep\|>", -1)
        return F.transform(F.split(F.get(parts, F.lit(1)), r"<\|im_next\|>", -1),
                           lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, one after another."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
