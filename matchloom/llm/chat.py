r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is trainable.
A turn is written as "### <role>: <text></turn>\n". In roles and texts the characters \ < # (in roles also :) are
written \s \l \h \c, so no text can hold a marker, and reading back is plain replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BETWEEN, END = "### ", ": ", "</turn>\n"
CODES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in CODES if role else CODES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in CODES[::-1]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """Training examples of conversations(conv_id, turn, role, text, ...), rows by turn.

    Returns conv_id, example (from 1), is_target, formatted, loss_start, loss_end: only code points loss_start
    (inclusive) to loss_end (exclusive) of formatted are trainable. Turns after the last target make one more row
    without a trainable part, so that nothing is lost; it is also what a conversation without target turns becomes.
    Turns are ordered by turn (null first), then role, then text. Null texts and roles are empty; rows repeated in full
    are turns of their own; a null conv_id is a conversation; an empty table gives an empty result.

    A conversation is put together in one task, as each example holds everything before its target.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t_"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t_")).alias("t_"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit(BETWEEN))
    convs = convs.select("conv_id", "t_", F.transform("t_", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target).alias("is_target"))).alias("f_"))
    convs = convs.select("conv_id", "f_", F.transform("f_", lambda f: F.concat(f["head"], f["body"], F.lit(END))).alias("s_"), F.size("f_").alias("n_"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n_")), lambda i: F.get("f_", i - 1)["is_target"] | (i == F.col("n_")))
    rows = convs.select("conv_id", "f_", "s_", F.posexplode(ends).alias("example_", "end_"))
    last = F.get("f_", F.col("end_") - 1)
    rows = rows.select("conv_id", (F.col("example_") + 1).alias("example"), last["is_target"].alias("is_target"), F.array_join(F.slice("s_", 1, F.col("end_")), "").alias("formatted"), F.length(last["body"]).alias("body_"))
    close = F.length("formatted") - len(END)
    return rows.select("conv_id", "example", "is_target", "formatted", F.when(F.col("is_target"), close - F.col("body_")).otherwise(close).alias("loss_start"), close.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted example."""
    turns = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(len(START) + 1)), BETWEEN, 1)).alias("role"), unescape(F.substr(t, F.instr(t, BETWEEN) + len(BETWEEN))).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their formatted strings.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last_"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss_"),
    )
    rows = rows.withColumn("turns_", read_turns(F.col("last_")))
    text = F.array_join(F.transform("turns_", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns_").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss_").cast("long").alias("loss_chars"), F.sha2("loss_", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
