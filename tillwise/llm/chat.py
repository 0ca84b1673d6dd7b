"""Collapse logged conversations that are prefixes of longer ones, then render the rest as chat text.

Systems that log a conversation after every turn leave snapshots of all its lengths. Each conversation gets one hash per
prefix of its turns; a conversation whose own hash is a shorter prefix's hash of another one is a snapshot. An
anti-join keeps the maximal ones. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.plans.scratch import save

# fixed values: the markup of the rendered text
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, turns (array of role, text in order) of every conversation.

    Turns go by number, a missing number first, ties by role and text; equal rows count once. A missing role is
    written as 'unknown', a missing text as empty. Turns without a conversation id belong to none and are left out.
    A conversation is one output text, so its turns meet in one task.
    """
    said = turns.where(col(conv_id).isNotNull()).select(
        col(conv_id).alias("conv_id"),
        F.struct(
            col(turn).alias("turn"), F.coalesce(col(role), F.lit("unknown")).alias("role"),
            F.coalesce(col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    listed = said.groupBy("conv_id").agg(F.sort_array(F.collect_set("said")).alias("said"))
    return listed.select("conv_id", F.transform("said", lambda s: F.struct(s["role"], s["text"])).alias("turns"))


def prefix_hashes(listed: DataFrame) -> DataFrame:
    """``listed`` with hashes: entry k covers the first k + 1 turns, each two 64-bit numbers as one text."""
    start = F.struct(
        F.lit(42).cast("long").alias("a"), F.lit(43).cast("long").alias("b"), F.array().cast("array<string>").alias("all")
    )

    def step(acc, said):  # the hash of a prefix rolls on to the next turn
        a = F.xxhash64(acc["a"], said["role"], said["text"])
        b = F.xxhash64(said["text"], acc["b"], said["role"], F.lit(7))
        return F.struct(a.alias("a"), b.alias("b"), F.concat(acc["all"], F.array(F.concat_ws(":", a, b))).alias("all"))

    return listed.withColumn("hashes", F.aggregate("turns", start, step, lambda acc: acc["all"]))


def maximal(listed: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another; of equal ones the smallest conv_id, with n_copies.

    Hot prefixes (a greeting that opens a third of all conversations) cost one row per task, because prefixes are
    made distinct before they are shuffled.
    """
    hashed = save(prefix_hashes(listed))
    own = F.element_at("hashes", -1)
    first = hashed.groupBy(own.alias("own")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    first = save(first)
    # proper prefixes only: all but the last
    before = F.slice("hashes", 1, F.size("hashes") - 1)
    longer = hashed.where(F.size("hashes") > 1).select(F.explode(before).alias("own")).distinct()
    kept = first.join(longer, "own", "left_anti")
    return hashed.drop("hashes").join(kept.select("conv_id", "n_copies"), "conv_id")


def render(listed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: each turn between the markup, roles first."""
    said = F.transform("turns", lambda s: F.concat(F.lit(OPEN), s["role"], F.lit("\n"), s["text"], F.lit(CLOSE)))
    return listed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(said, "\n").alias("chat")
    )


def chat_texts(turns: DataFrame, **names: str) -> DataFrame:
    """Rendered maximal conversations of a table of turns; an empty table gives none. See conversations()."""
    return render(maximal(conversations(turns, **names)))
