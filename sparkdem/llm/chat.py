"""Chat formatting by DataFrame expressions only.

The template: a block for each run of turns of one role, <|start|>role<|text|>text<|sep|>text ...<|end|> and a line end.
Inside roles and texts a backslash becomes two and "<|" becomes "<\\|", so no control string is left in them, and every
backslash that is left starts one of these two escapes: unescaping is exact.

Turns are collected and sorted as structs, spread again in that order, numbered by blocks, and merged by array
aggregation, first to blocks, then to conversations. All steps keep the partitioning by conversation, so there is one
shuffle; running sums over the turns give the loss mask, so the work is in proportion to the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
START, TEXT, SEP, END = "<|start|>", "<|text|>", "<|sep|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def format_chats(df: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss (array of start and end, in characters from 0) of each conversation.

    Turns are sorted by turn, then role and text, nulls first; repeated rows all stay. Null roles and texts are empty.
    Adjacent turns of one role share a block. The loss mask covers the escaped texts of loss_role and nothing between
    them. A null conv_id is a conversation. A conversation is one value of the result, so it must fit into a row. An empty
    table gives no rows. Columns other than the four named aren't read, so their names can't clash.
    """
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    chats = df.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = chats.select("conv_id", F.posexplode("turns").alias("pos", "t"))
    turns = turns.select("conv_id", "pos", F.col("t.role").alias("raw"), escape(F.col("t.role")).alias("role"), escape(F.col("t.text")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("pos")
    turns = turns.withColumn("begins", F.coalesce(F.lag("raw").over(order) != F.col("raw"), F.lit(True)))
    # what stands between a turn's text and the one before
    head = F.length("role") + len(START + TEXT) + F.when(F.col("pos") > 0, len(END) + 1).otherwise(0)
    between = F.when(F.col("begins"), head).otherwise(len(SEP))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({"block": F.sum(F.col("begins").cast("int")).over(upto), "end": F.sum(between + F.length("text")).over(upto)})
    span = F.when(F.col("raw") == loss_role, F.struct((F.col("end") - F.length("text")).alias("start"), F.col("end").alias("end")))
    placed = F.struct("pos", "text", span.alias("span"))
    blocks = turns.groupBy("conv_id", "block", "role").agg(F.array_sort(F.collect_list(placed)).alias("merged"))
    body = F.concat(F.lit(START), F.col("role"), F.lit(TEXT), F.array_join("merged.text", SEP), F.lit(END + "\n"))
    spans = F.filter("merged.span", lambda s: s.isNotNull())
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", body.alias("body"), spans.alias("spans")))).alias("blocks"))
    loss = "transform(flatten(blocks.spans), s -> struct(int(s.start) as start, int(s.end) as end))"
    return whole.select("conv_id", F.array_join("blocks.body", "").alias("formatted"), F.expr(loss).alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, in order, one for each turn that was formatted), loss_text: the inverse."""
    quote = lambda s: s.replace("|", r"\|")
    blocks = F.split(F.col("formatted"), quote(START))
    parts = F.transform(F.slice(blocks, F.lit(2), F.greatest(F.lit(0), F.size(blocks) - 1)), lambda b: F.split(b, quote(TEXT)))
    bodies = F.transform(
        parts, lambda p: F.struct(unescape(p[0]).alias("role"), F.split(F.regexp_replace(p[1], quote(END) + r"\n\z", ""), quote(SEP)).alias("texts"))
    )
    turns = F.flatten(F.transform(bodies, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    # four bytes a character, so a span is found without counting characters from the start; the text is encoded once, as
    # a lambda's variable, since a column would be put into the inner lambda and encoded for each span
    cut = """element_at(transform(array(encode(formatted, 'UTF-32')),
        u -> transform(loss, s -> decode(substring(u, 4 * s.start + 1, 4 * (s.end - s.start)), 'UTF-32'))), 1)"""
    # an escape never goes over the end of a text, so what is under the mask can be unescaped as a whole
    return formatted.select("conv_id", turns.alias("turns"), unescape(F.array_join(F.expr(cut), "")).alias("loss_text"), "formatted")
