"""Chat formatting with a grammar round trip, in SQL functions only.

A conversation renders to ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.
The parser is deterministic: cut at each start mark, the role ends at the first
line feed, the end mark closes the text, and escapes are undone.  A turn is
first rendered as it is; where the parser does not give it back (the text holds
a control string, or what would read as an escape), the turn is rendered with
escapes, and the round trip is compared again.

Escape: in ``<``, any number of backslashes, ``|`` one more backslash goes before
the bar.  An escaped text holds no ``<|``, and undoing takes one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings.
START, END, STOP = "<|im_start|>", "<|im_end|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role also holds no line feed, for that ends it."""
    return escape(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def _render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(STOP))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text).

    Returns conv_id, formatted, mask (spans ``start``, ``stop`` in code points of
    ``formatted`` that carry loss: the texts of assistant turns), n_escaped (turns
    whose content had to be escaped) and round_trip (the parser gives the source
    turns back).

    Turns go by ``turn`` (nulls first), then role and text, so ties and repeated
    rows have a fixed order and all stay.  A null role or text is an empty one.
    Rows with a null conv_id form one conversation.  An empty table gives no rows."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    role, text = F.col("t.role"), F.col("t.text")
    # the parser, run over the turn rendered as it is
    back = F.transform(parse(_render_turn(role, text)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = back.eqNullSafe(F.array(F.struct(role.alias("role"), text.alias("text"))))
    conflict = ~same | text.contains(END) | role.contains(END)
    turns = rows.select("conv_id", turn.alias("t")).select(
        "conv_id",
        F.struct(
            F.col("t.turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            conflict.alias("conflict"),
            F.when(conflict, escape_role(role)).otherwise(role).alias("out_role"),
            F.when(conflict, escape(text)).otherwise(text).alias("out"),
        ).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select(
        "conv_id", "turns",
        F.array_join(F.transform("turns", lambda t: _render_turn(t["out_role"], t["out"])), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["conflict"])).cast("long").alias("n_escaped"),
    )
    chats = chats.withColumn("parsed", parse(F.col("formatted")))
    same = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return chats.select("conv_id", "formatted", mask(F.col("parsed")).alias("mask"), "n_escaped", F.coalesce(same, F.lit(False)).alias("round_trip"))


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation: array of (role, text, n_part, n_head, n_raw), lengths in code points of the rendered text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)

    def turn(p: Column) -> Column:
        head = F.instr(p, "\n")
        raw = F.substring(p, head + 1, F.length(p) - head - len(STOP))
        ok = (head > 0) & p.endswith(STOP)
        return F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            F.when(ok, unescape(raw)).alias("text"),
            (F.length(p) + len(START)).alias("n_part"),
            (head + len(START)).alias("n_head"),
            F.length(raw).alias("n_raw"),
        )

    return F.transform(parts, turn)


def mask(parsed: Column, role: str = "assistant") -> Column:
    """Spans of the texts of ``role`` turns in the rendered text."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    walked = F.aggregate(
        parsed,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["n_part"]).alias("at"),
            F.when(
                t["role"] == role,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["n_head"]).alias("start"), (acc["at"] + t["n_head"] + t["n_raw"]).alias("stop")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]
