"""Operator 7: collapse logged snapshots of growing conversations, then render.

A log often holds a conversation several times, each longer than the last. The
rolling hash of a turn is the sum of the hashes of (place, role, text) of all
turns up to it, so the hash of a whole conversation equals the hash at that
place in any conversation that begins with it. Of equal conversations the one
with the smallest id stays; a conversation whose whole hash and length are also
those of a proper prefix of another is dropped by an anti-join; what is left is
maximal and is rendered. DataFrame functions only.

Turns are ordered by ``turn`` (nulls first), role and text, and their place is
their rank. Places and rolling hashes are worked out per block of ``turn``
numbers and offset by the blocks before, so that a conversation with very many
turns is spread over tasks; for the same reason it is rendered in parts of
``part_turns`` turns, in order (``part`` 0 holds an ordinary conversation
whole). Repeated rows are turns of their own. A null role or text is rendered
as empty, but is not equal to an empty one. A null ``conv_id`` is a
conversation of its own, like any other id. An empty table gives an empty
result; extra columns are ignored.

Hash sums are decimals: they cannot overflow, and two sums of different turns
agree only with odds of about one in 2**62.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, block_turns: int) -> DataFrame:
    """``(c, conv_id, place, role, text, h)``: every turn with its place and
    the rolling hash up to it; ``c`` is a key that is never null."""
    c = F.when(F.col("conv_id").isNull(), "null").otherwise(F.col("conv_id").cast("string"))
    rows = conversations.select(c.alias("c"), "conv_id", "turn", "role", "text",
                                F.coalesce(F.expr(f"floor(turn / {block_turns})"), F.lit(-1 << 62)).alias("b"))
    order = Window.partitionBy("c", "b").orderBy("turn", "role", "text")
    rows = rows.withColumn("r", F.row_number().over(order).cast("long"))
    counts = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("c", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rows = rows.join(counts, ["c", "b"]).withColumn("place", F.col("n0") + F.col("r") - 1)
    one = F.xxhash64("place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(38,0)")
    rows = rows.withColumn("x", one)
    sums = rows.groupBy("c", "b").agg(F.sum("x").alias("s"))
    sums = sums.select("c", "b", F.coalesce(F.sum("s").over(before), F.lit(0)).cast("decimal(38,0)").alias("s0"))
    run = F.sum("x").over(Window.partitionBy("c", "b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("run", run).join(sums, ["c", "b"])
            .select("c", "conv_id", "place", "role", "text", (F.col("run") + F.col("s0")).cast("decimal(38,0)").alias("h")))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(c, n_turns)`` of the conversations that are neither a copy of one
    with a smaller id nor a proper prefix of another."""
    whole = turns.groupBy("c").agg(F.max(F.struct("place", "h")).alias("e"), F.first("conv_id").alias("conv_id"))
    whole = whole.select("c", "conv_id", F.col("e.place").alias("place"), F.col("e.h").alias("h"))
    kept = whole.groupBy("place", "h").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "c")).alias("k")).select(F.col("k.c").alias("c"), "place", "h")
    # every proper prefix of a kept conversation, once
    inner = (turns.join(kept.select("c", F.col("place").alias("last")), "c").where("place < last").select("place", "h").distinct())
    return kept.join(inner, ["place", "h"], "left_anti").select("c", (F.col("place") + 1).alias("n_turns"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def format_chats(conversations: DataFrame, part_turns: int = 1024, block_turns: int = 1024) -> DataFrame:
    """``conversations(conv_id, turn, role, text, ...)`` to ``(conv_id, part,
    n_turns, rendered)``: the maximal conversations, in parts of ``part_turns``."""
    turns = _turns(conversations, block_turns)
    text = rendered_turn(F.col("role"), F.col("text"))
    return (turns.join(maximal_conversations(turns), "c")
            .withColumn("part", F.expr(f"place div {part_turns}"))
            .groupBy("c", "part").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"),
                                      F.array_sort(F.collect_list(F.struct("place", text.alias("t")))).alias("ts"))
            .select("conv_id", "part", "n_turns", F.array_join(F.transform("ts", lambda t: t["t"]), "").alias("rendered")))


def oracle(part_turns: int = 1024, conversations: str = "conversations") -> str:
    """The same in SQL, from the lists of turns themselves."""
    return f"""
WITH whole AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM {conversations} GROUP BY conv_id),
kept AS (SELECT min(conv_id) AS conv_id, turns FROM whole GROUP BY turns),
prefixes AS (SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM kept)),
maximal AS (SELECT conv_id, turns FROM kept ANTI JOIN prefixes USING (turns)),
parts AS (SELECT conv_id, len(turns) AS n_turns, part, turns[part * {part_turns} + 1:(part + 1) * {part_turns}] AS turns
          FROM (SELECT *, unnest(range(0, (len(turns) - 1) // {part_turns} + 1)) AS part FROM maximal))
SELECT conv_id, part, n_turns,
       array_to_string(list_transform(turns, lambda t: '{START}' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '{END}' || chr(10)), '') AS rendered
FROM parts"""
