"""Chat formatting with a grammar that is checked by reading the output back; DataFrame functions only.

Template of a turn: ``<|im_start|>`` role, line feed, text, ``<|im_end|>`` line feed.  The reader splits the output at
``<|im_end|>`` line feed, takes role and text of every part, and undoes the escapes ``%0A`` (line feed), ``%7C`` (|) and ``%25`` (%).
A turn is first rendered as it is and read back; only where the turn read differs from its source, its conflicting characters
are escaped.  Escaped content holds no ``|`` and no ``%`` but those of escapes, so the second reading is always identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fabsight.llm.common import session

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))
    return F.replace(out, F.lit("\n"), F.lit("%0A")) if line_feeds else out


def unescape(text: Column) -> Column:
    for code, char in (("%0A", "\n"), ("%7C", "|"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def read_turn(part: Column) -> Column:
    """(role, text) of what stands before an end mark; null if it is no turn of the grammar."""
    body = F.substring(part, len(START) + 1, 2147483647)
    cut = F.instr(body, "\n")
    fits = F.startswith(part, F.lit(START)) & (cut > 0) & ~F.contains(body, F.lit(START)) & ~F.contains(body, F.lit(END))
    role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + 1)
    return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, by the grammar alone."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), read_turn)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, turns, escaped_turns) per conversation.

    ``loss_spans`` are (start, length) in code points of the texts of assistant turns in ``formatted``; ``turns`` is what the
    reader gives back from ``formatted``.  Rows are ordered by turn, then role, then text, nulls first; null roles and texts
    are empty; repeated rows are turns of their own; a null conv_id is one conversation; other columns are ignored; no rows
    give no rows.  Positions come from a window over the turns; only the rendered turns of a conversation, which is one
    training example, meet in a row.
    """
    session(rows.sparkSession)
    plain = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = read_back(render(F.col("role"), F.col("text")))
    same = (F.size(whole) == 1) & F.coalesce((whole[0]["role"] == F.col("role")) & (whole[0]["text"] == F.col("text")), F.lit(False))
    # the shuffle carries the source and two lengths; texts are rendered behind it
    role_out = F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"), True))
    text_out = F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text")))
    sized = plain.withColumn("same", same).withColumns({"length": F.length(text_out).cast("long"), "size": F.length(render(role_out, text_out)).cast("long")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = (sized.withColumns({"end": F.sum("size").over(order), "nth": F.row_number().over(order)})
              .withColumn("rendered", render(role_out, text_out)))
    start = F.col("end") - len(END) - 1 - F.col("length")
    span = F.when(F.col("role") == ASSISTANT, F.struct(start.alias("start"), F.col("length").alias("length")))
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "rendered", span.alias("span")))).alias("all"),
        F.sum((~F.col("same")).cast("long")).alias("escaped_turns"))
    formatted = F.array_join(F.col("all")["rendered"], "")
    return (gathered.select("conv_id", formatted.alias("formatted"), F.filter(F.col("all")["span"], lambda s: s.isNotNull()).alias("loss_spans"), "escaped_turns")
            .withColumn("turns", read_back(F.col("formatted")))
            .select("conv_id", "formatted", "loss_spans", "turns", "escaped_turns"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from the output."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # four bytes a code point: a span is found without counting from the start
    cut = lambda s: F.decode(F.substr(F.col("wide"), (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "")
    return (chats.withColumn("wide", F.encode("formatted", "UTF-32"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"))
