"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are its prompt, and only its reply
is trainable. Turns after the last assistant turn make one more row, without a completion.

increments() orders and formats the turns; each of its rows holds what an example adds to the one before
it, so it grows with the conversation. examples() joins them into whole prompts, whose size grows with the
square of a conversation's turns, as this kind of example does: a conversation's prompts are made by one
task, and each is one value, so a conversation has to fit in a worker's memory many times over.

A turn is <|im_start|>role, line feed, text, <|im_end|>, line feed. A backslash in a role or text is
doubled and one is put into whatever could be read as a control string (this template's, and those of
other common ones), so no text can open or close a turn; parse() undoes both.

Order: conversations' turns go by turn number (nulls first), then role, then text. Positions are counted
in blocks of BLOCK turn numbers and then over blocks, so a conversation that holds a third of all rows
is dealt out over many tasks.

Cases: null role or text is empty; repeated rows are turns of their own; a null conv_id is a conversation
of its own; an empty table gives no examples; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, TARGET, BLOCK = "<|im_start|>", "<|im_end|>\n", "assistant", 256
_CONTROL = r"(<(?=\||/?s>|<SYS>>|</SYS>>|/?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), escape(text), F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of formatted text: an array of (role, text, raw), raw being the text as it stands there."""
    bodies = F.transform(F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != ""), lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.char_length(x)))
    head = r"^([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n"
    split = F.transform(bodies, lambda x: F.struct(F.regexp_extract(x, head, 1).alias("role"), x.alias("body")))
    return F.transform(split, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(_after(t)).alias("text"), _after(t).alias("raw")))


def _after(t: Column) -> Column:
    return F.substring(t["body"], F.char_length(t["role"]) + 2, F.char_length(t["body"]))


def increments(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), added (formatted turns since the example before), target (null after the last assistant turn), loss_start and loss_end within the target."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(
        F.col("conv_id"), "turn", "role", "text", format_turn(F.col("role"), F.col("text")).alias("formatted"),
        (F.col("role") == TARGET).cast("long").alias("is_target"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).alias("block"),
    )
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = rows.withColumns({"place": F.row_number().over(inner), "before": F.sum("is_target").over(inner.rowsBetween(Window.unboundedPreceding, -1))})
    outer = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(F.sum("is_target").alias("t"))
    blocks = blocks.select("c", "b", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("t"))
    met = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    item = F.struct("block", "place", "formatted", "is_target", F.char_length(F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))).alias("head"))
    grouped = met.groupBy("conv_id", (F.col("t") + F.coalesce("before", F.lit(0))).alias("example")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    last = F.element_at("x", -1)
    rest = F.when(last["is_target"] == 1, F.slice("x", F.lit(1), F.size("x") - 1)).otherwise(F.col("x"))
    context = F.array_join(F.transform(rest, lambda t: t["formatted"]), "")
    own = F.when(last["is_target"] == 1, last["formatted"])
    return grouped.select(
        "conv_id", "example", context.alias("added"), own.alias("target"),
        F.when(own.isNotNull(), last["head"]).alias("loss_start"), (F.char_length(own) - len(CLOSE)).alias("loss_end"),
    )


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), prompt (all turns before), completion (null after the last assistant turn), loss_start and loss_end: the trainable characters of the completion."""
    found = increments(conversations, conv_id, turn, role, text)
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.array_join(F.collect_list(F.concat("added", F.coalesce("target", F.lit("")))).over(before), "")
    return found.select("conv_id", "example", F.concat(prefix, "added").alias("prompt"), F.col("target").alias("completion"), "loss_start", "loss_end")


def digest(found: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: conv_id, n (turns), all (roles and texts), loss, chars (of the conversation, formatted), expanded (of all examples).

    Turns are read from the last example, which holds all of them, and the loss from each example's
    completion. Completions are joined in blocks of examples first.
    """
    loss = unescape(F.substring(F.col("completion"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = F.concat("prompt", F.coalesce("completion", F.lit("")))
    size = F.when(F.col("completion").isNotNull(), F.char_length(whole)).otherwise(0).cast("long")
    read = found.select("conv_id", "example", F.floor(F.col("example") / BLOCK).alias("b"), whole.alias("whole"), F.coalesce(loss, F.lit("")).alias("loss"), size.alias("expanded"))

    def joined(df: DataFrame, order: str, *by: str) -> DataFrame:
        one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "loss"))), lambda x: x["loss"]), "")
        return df.groupBy(*by).agg(one.alias("loss"), F.max_by("whole", order).alias("whole"), F.sum("expanded").alias("expanded"))

    made = joined(joined(read, "example", "conv_id", "b"), "b", "conv_id").withColumn("turns", parse(F.col("whole")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join(said, "").alias("all"), "loss", F.char_length("whole").cast("long").alias("chars"), "expanded")
