r"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A turn is written `<|im_start|>role` newline `text<|im_end|>` newline. Inside roles and texts, `\` is written `\\`, `<` is `\l` and `[` is `\b`
(in roles, a newline is `\n`): no control string, of this template or of another that starts with `<` or `[`, can stand inside, and
reading reverses it. Every assistant turn becomes an example: all turns before it and its own head as context, and its text, the only part under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(col: Column, newline: bool = False) -> Column:
    """Reverse of escape: between escaped backslashes, read left to right, the other codes can't be mistaken."""

    def part(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
        return F.replace(x, F.lit("\\n"), F.lit("\n")) if newline else x

    return F.array_join(F.transform(F.split(col, r"\\\\", -1), part), "\\")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans): one row per conversation; spans has, for each assistant turn in order, `turn` (from 0), `start` and `length` of
    its escaped text in `formatted`, in characters.

    Turns are ordered by turn (null first), then role and text, so ties are settled; repeated rows are turns of their own. A null role or text is empty.
    Rows with a null conv_id are one conversation. A conversation is one value of the output, so it must fit in 2 GB; its rows meet in one task only after column pruning.
    Other columns are not read. An empty table gives an empty result.
    """
    empty = F.lit("")
    order = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("order")
    head = F.concat(F.lit(START), F.replace(escape(F.col("order.role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("order.text"))
    chars = (F.length(head) + F.length(body) + len(END)).cast("bigint")
    rows = turns.select(F.col(conv_col).alias("conv_id"), order).withColumn("chars", chars)
    # Places by running sums over the turns in order: the window sorts a conversation's turns (spilling if need be), its one dealing by conv_id serves the lists too, and texts are escaped after it.
    upto = Window.partitionBy("conv_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("order")) - 1).withColumn("upto", F.sum("chars").over(upto))
    start = F.col("upto") - F.col("chars") + F.length(head)
    span = F.struct(F.col("n").alias("turn"), start.alias("start"), F.length(body).cast("bigint").alias("length"))
    rows = rows.select("conv_id", F.struct("n", F.concat(head, body, F.lit(END)).alias("text")).alias("t"), F.when(F.col("order.role") == assistant, span).alias("span"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sort_array(F.collect_list("span")).alias("spans"))
    return lists.select("conv_id", F.array_join(F.transform("ts", lambda t: t["text"]), "").alias("formatted"), "spans")


def expand(formatted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, turn, context, target[, keep]): one example per assistant turn: context is all that stands before its text, target the text, both as formatted.
    Conversations without an assistant turn have no example. The contexts of a conversation of n turns hold about n / 2 times its text."""
    out = formatted.select("conv_id", *keep, "formatted", F.explode("spans").alias("s"))
    context = F.substring("formatted", F.lit(1), F.col("s.start").cast("int"))
    target = F.substring("formatted", (F.col("s.start") + 1).cast("int"), F.col("s.length").cast("int"))
    return out.select("conv_id", *keep, F.col("s.turn").alias("turn"), context.alias("context"), target.alias("target"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text (or from a context, whose last turn is then without text)."""
    turns = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.slice(turns, F.lit(2), F.size(turns))  # nothing stands before the first mark
    cut = F.transform(turns, lambda t: F.struct(F.substring_index(t, "\n", 1).alias("role"), F.replace(F.substring(t, F.instr(t, "\n") + 1, F.length(t)), F.lit(END), F.lit("")).alias("text")))
    return F.transform(cut, lambda t: F.struct(unescape(t["role"], True).alias("role"), unescape(t["text"]).alias("text")))
