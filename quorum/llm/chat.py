r"""Chat formatting with a grammar round trip, in SQL functions only.

The template of a turn is ``### role:\ntext</turn>``; turns are joined by a line feed. A conversation is first rendered
as it is and reparsed by a deterministic parser: cut at ``</turn>``, take the header up to the first line feed, undo the
escapes. If the recovered turns differ from the source, the turns that do not survive alone are escaped; if the result
still differs, all of them are. The escape is a backslash and one letter for backslash, ``<``, ``#`` and, in roles, the
line feed, so an escaped text holds neither a marker nor a lone backslash, and the last step always restores the source.

The loss mask is a list of [start, end) code points of the assistant's texts in the rendered text.

Scale: one shuffle, by conversation, of the turns themselves. A conversation is one value of the result, so its turns
meet in one row; nothing wider than a conversation does.

Cases: a null role or text is empty; turns are ordered by number (null first), then role and text, so ties and repeated
rows have a fixed place; rows without a conversation id form one conversation with a null id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col

END = "</turn>"
#: Characters and their escapes, in the order in which they are replaced; the backslash comes first and is undone last.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"), ("\n", "\\w"))


def _replace(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(text: Column, role: bool = False) -> Column:
    return _replace(text, ESCAPES if role else ESCAPES[:3])


def unescape(text: Column, role: bool = False) -> Column:
    return _replace(text, [(b, a) for a, b in reversed(ESCAPES if role else ESCAPES[:3])])


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("### "), t["role"], F.lit(":\n"), t["text"], F.lit(END))), "\n")


def parse(rendered: Column) -> Column:
    """The turns (role, text) that a rendered conversation states, unescaped."""
    pieces = F.split(rendered, END, -1)

    def turn(piece: Column, k: Column) -> Column:
        own = F.substring(piece, F.when(k == 0, 1).otherwise(2), F.length(piece))
        header = F.substring_index(own, "\n", 1)
        role = F.substring(header, F.lit(5), F.length(header) - 5)
        return F.struct(unescape(role, True).alias("role"), unescape(F.substring(own, F.length(header) + 2, F.length(own))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def _survives(t: Column) -> Column:
    """Whether a turn stays itself when it is rendered and parsed without an escape."""
    role, text = t["role"], t["text"]
    return (unescape(role, True) == role) & (unescape(text) == text) & ~F.contains(F.concat(role, F.lit("\n"), text), F.lit(END)) & ~F.contains(role, F.lit("\n"))


def _escaped(t: Column) -> Column:
    return F.struct(escape(t["role"], True).alias("role"), escape(t["text"]).alias("text"))


def _spans(turns: Column, role: str) -> Column:
    """[start, end) of the texts of one role in render(turns)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + 6
        end = begin + F.length(t["text"])
        return F.struct((end + len(END) + 1).alias("at"), F.when(t["role"] == role, F.array_append(state["spans"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans and level (0 as it is, 1 conflicting turns escaped, 2 all escaped)."""
    empty = F.lit("")
    turn = F.struct(col(turn_col).alias("turn"), F.coalesce(col(role_col), empty).alias("role"), F.coalesce(col(text_col), empty).alias("text"))
    grouped = rows.select(col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    source = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    same = lambda shape: parse(render(shape)) == F.col("source")
    some = F.transform("source", lambda t: F.when(_survives(t), t).otherwise(_escaped(t)))
    level = F.when(same(F.col("source")), 0).when(same(some), 1).otherwise(2)
    levelled = source.withColumn("level", level)
    shape = F.when(F.col("level") == 0, F.col("source")).when(F.col("level") == 1, some).otherwise(F.transform("source", _escaped))
    return levelled.withColumn("shape", shape).select("conv_id", render(F.col("shape")).alias("formatted"), _spans(F.col("shape"), loss_role).alias("loss_spans"), "level")


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under a loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
