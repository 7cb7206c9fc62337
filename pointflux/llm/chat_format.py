"""Conversations as marked-up text with a loss mask, in Spark expressions only.

A conversation is a row of blocks::

    ### role: first text<|+|>next text of the same role</turn>\\n

Adjacent turns of one role share a block. Control strings inside roles and texts
are replaced by escapes that hold no control string and don't overlap with one,
so splitting at the control strings gives the turns back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut, pieces, running

OPEN, SPLIT, NEXT, CLOSE, LINE = "### ", ": ", "<|+|>", "</turn>", "\n"
#: In this order when escaping and in the opposite one when reading; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("<|+|>", "\\n"))
COLON = (":", "\\c")


def escape(text: Column, role: bool = False) -> Column:
    for raw, code in (*ESCAPES, *[COLON] * role):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for raw, code in reversed((*ESCAPES, *[COLON] * role)):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_from: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row per conversation.

    Turns are sorted by (turn, role, text), a null turn first; a null role or
    text counts as empty. Repeated rows stay, each as a turn. ``loss_spans`` are
    the code-point ranges (start, end exclusive) of the texts of ``learn_from``
    in ``formatted``, in order, without markers; an empty text has an empty
    range. Rows with a null conv_id form one conversation. Other columns are
    ignored; an empty table gives no rows.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    talks = talks.withColumn("first", first)
    blocks = F.transform(
        "first",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get("first", k + 1), n) - s), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    talks = talks.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), escape(b["role"], role=True), F.lit(SPLIT))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE + LINE))), "")
    # Each text with the length of the markup before it; running sums turn lengths into ranges.
    marked = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i > 0, F.lit(len(NEXT))).otherwise(F.length(head(b)) + F.when(k > 0, F.lit(len(CLOSE + LINE))).otherwise(0)).alias("skip"),
                    F.length(t).alias("size"),
                    (b["role"] == learn_from).alias("learn"),
                ),
            ),
        )
    )

    def spans(m: Column) -> Column:
        ends = running(F.transform(m, lambda x: x["skip"] + x["size"]))
        ranged = F.zip_with(m, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["learn"].alias("learn")))
        return F.transform(F.filter(ranged, lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return talks.select("conv_id", formatted.alias("formatted"), bound(marked, spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns of a formatted conversation, as they went in."""
    ended = F.split(formatted, CLOSE + LINE)
    blocks = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turns(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(OPEN) + 1))
        at = F.instr(inner, SPLIT)
        role = unescape(F.substr(inner, F.lit(1), at - 1), role=True)
        texts = F.split(F.substr(inner, at + len(SPLIT)), r"<\|\+\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order, nothing between them."""
    return bound(pieces(formatted), lambda p: F.array_join(F.transform(spans, lambda s: unescape(cut(p, s["start"], s["end"] - s["start"]))), ""))
