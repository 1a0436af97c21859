"""Conversation analytics over ``(conv_id, turn, role, text)`` logs.

Per-conversation results are aggregates (``max_by``, counts), and
neighbouring turns are paired by an equi-join on ``(conv_id, turn + 1)``
-- a unique key -- so a very long conversation never has to be sorted or
buffered in one task.  Message lists are cut into pages of at most
``page_size`` turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 256


def last_message(conv: DataFrame) -> DataFrame:
    """Newest turn of each conversation."""
    m = conv.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("m"))
    return m.select("conv_id", "m.turn", "m.role", "m.text")


def with_system_prompt(conv: DataFrame, system_text: str) -> DataFrame:
    """The first turn of every conversation replaced by the system prompt."""
    first = conv.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    is_first = F.col("turn") == F.col("first_turn")
    return (conv.join(first, "conv_id", "inner")
            .select("conv_id", "turn",
                    F.when(is_first, F.lit("system")).otherwise(F.col("role")).alias("role"),
                    F.when(is_first, F.lit(system_text)).otherwise(F.col("text")).alias("text")))


def transcripts(conv: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Message lists ``[{role, content}, ...]`` in turn order, one row per
    conversation page of at most ``page_size`` turns, as JSON text."""
    paged = conv.withColumn("page", F.floor(F.col("turn") / page_size).cast("int"))
    grouped = paged.groupBy("conv_id", "page").agg(
        F.count("*").alias("n_messages"),
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    msgs = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return grouped.select("conv_id", "page", "n_messages", F.to_json(msgs).alias("messages"))


def metrics(conv: DataFrame) -> DataFrame:
    """Per conversation: turns, turns per role, mean text length of user
    and assistant turns, and the number of user turns answered by the
    assistant in the next turn."""
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    paired = conv.join(nxt, ["conv_id", "turn"], "left")
    answered = (F.col("role") == "user") & (F.col("next_role") == "assistant")
    length = F.length("text")
    return (paired.groupBy("conv_id")
            .agg(F.count("*").alias("n_turns"),
                 F.count(F.when(F.col("role") == "user", 1)).alias("n_user"),
                 F.count(F.when(F.col("role") == "assistant", 1)).alias("n_assistant"),
                 F.count(F.when(F.col("role") == "system", 1)).alias("n_system"),
                 F.round(F.avg(F.when(F.col("role") == "user", length)), 4).alias("avg_user_chars"),
                 F.round(F.avg(F.when(F.col("role") == "assistant", length)), 4).alias("avg_assistant_chars"),
                 F.count(F.when(answered, 1)).alias("n_answered")))
