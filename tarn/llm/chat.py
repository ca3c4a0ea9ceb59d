"""Chat formatting with Spark expressions only: the turn structs of a conversation are collected, sorted, merged where the same role goes on, and concatenated.

A block is <|im_start|>role, a line feed, the texts of adjacent turns of that role with <|im_sep|> between, <|im_end|> and a line feed.
Inside roles and texts "~" becomes "~0" and "<|" becomes "<~1" (in roles a line feed becomes "~2"), so no control string of a text survives, and reading back is exact.

The loss mask is a list of segments (text, loss) whose texts make up the formatted string; the texts of assistant turns are under it.

Defined results: null texts and roles count as empty, rows of a null conversation form one conversation, rows that tie in turn are ordered by role and text, and repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("~2"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("~2"), F.lit("\n")))


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>: one row per conversation of turns (conv_id, turn, role, text)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    begins = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.col("ts")[i]["role"] != F.col("ts")[F.greatest(i - 1, F.lit(0))]["role"]))
    rows = rows.withColumn("begins", begins)
    stops = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("ts")))
    blocks = F.transform(F.arrays_zip("begins", stops.alias("stops")), lambda x: F.slice(F.col("ts"), x["begins"] + 1, x["stops"] - x["begins"]))
    rows = rows.select("conv_id", F.transform(blocks, lambda ts: F.struct(ts[0]["role"].alias("role"), F.transform(ts, lambda t: t["text"]).alias("texts"))).alias("blocks"))

    def segments(block: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = part(F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")), F.lit(False))
        inner = F.transform(block["texts"], lambda t, i: F.array(part(F.when(i > 0, F.lit(SEP)).otherwise(F.lit("")), F.lit(False)), part(escape(t), block["role"] == "assistant")))
        return F.concat(F.array(head), F.flatten(inner), F.array(part(F.lit(END + "\n"), F.lit(False))))

    rows = rows.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return rows.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What reading back the output of format_chat gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("ts"), "segments")
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
