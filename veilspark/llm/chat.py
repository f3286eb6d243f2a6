"""Chat formatting of maximal conversations, with DataFrame functions only.

Logs hold snapshots: every request logs the conversation so far. Each turn gets a
rolling hash of all turns up to it. A conversation whose last hash is the hash of
a shorter prefix of another one is a snapshot of that one; it is removed by an
anti-join, as are exact copies but for the one of smallest id. What is left is
rendered.

The rolling hash is an exclusive-or over hashes of (position, turn). It can be summed
in blocks of turns, so that a conversation of any length never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: turns whose running hash is worked out together, and turns of one rendered part
BLOCK = 1024
# The marks of the rendered form.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _rows(turns: DataFrame) -> DataFrame:
    """Distinct rows with the key of their conversation; NULL role and text are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lone = F.concat(F.lit("r"), F.sha2(F.concat_ws("\x00", F.length(role).cast("string"), role, text), 256))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), lone)
    turn = F.when(F.col("conv_id").isNotNull(), F.col("turn")).cast("bigint")
    return turns.select("conv_id", conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text")).distinct()


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("unit"))


def rolling_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, conv_id, turn, pos, h1, h2, z1, z2): h is the hash of all turns up to pos, z of the turn alone."""
    row = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    part = lambda at: F.conv(F.substring("row", at, 15), 16, 10).cast("bigint")
    units = (_rows(turns).withColumn("row", row).groupBy("conv", "turn")
             .agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"),
                  F.bit_xor(part(1)).alias("u1"), F.bit_xor(part(16)).alias("u2"))
             .withColumn("unit", F.concat_ws("-", "n", "u1", "u2"))
             .withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / block)))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first())
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (units.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
              .select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    placed = (units.drop("n").join(counts, ["conv", "block"])
              .withColumn("pos", F.col("base") + F.row_number().over(inside))
              .withColumns({"z1": _hash(1), "z2": _hash(2)}))
    sums = (placed.groupBy("conv", "block").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
            .select("conv", "block", *(F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2))))
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(sums, ["conv", "block"])
            .withColumns({f"h{i}": F.bit_xor(f"z{i}").over(run).bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
            .select("conv", "conv_id", "turn", "pos", "h1", "h2", "z1", "z2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """Conversations (conv, n_turns) that are no proper prefix of another; of equal ones that of the smallest id."""
    whole = (hashes.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"),
                                        F.bit_xor("z1").alias("h1"), F.bit_xor("z2").alias("h2")))
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id"), F.col("conv"))).alias("first")
    distinct = whole.groupBy("n", "h1", "h2").agg(first)
    # without its own turn, the hash at a later position is that of a proper prefix
    prefixes = (hashes.where("pos > 1").select((F.col("pos") - 1).alias("n"), F.col("h1").bitwiseXOR(F.col("z1")).alias("h1"),
                                               F.col("h2").bitwiseXOR(F.col("z2")).alias("h2")).distinct())
    return distinct.join(prefixes, ["n", "h1", "h2"], "left_anti").select("first.conv", F.col("n").alias("n_turns"))


def render(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations in chat form.

    Turns go by number, NULL first; different rows of one turn number are one turn
    and go by role and text; exact repeats of a row count once. NULL and empty
    role or text are the same. A row without conv_id is a conversation of its own,
    of one turn. A conversation of more than ``block`` turns comes in parts 0, 1, ...
    An empty table gives no row; other columns are not read.
    """
    hashes = checkpoint(rolling_hashes(turns, block))
    kept = maximal(hashes)
    places = hashes.join(kept, "conv").select("conv", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "n_turns",
                                              F.floor((F.col("pos") - 1) / block).alias("part"))
    body = lambda r: F.concat(F.lit(BEGIN), r["role"], F.lit("\n"), r["text"], F.lit(END + "\n"))
    rows = _rows(turns).withColumn("turn", F.coalesce("turn", F.lit(-(1 << 62))))
    return (rows.join(places, ["conv", "turn"])
            .groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"),
                                         F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
            .select("conv_id", "part", "n_turns", F.array_join(F.transform("all", body), "").alias("text")))
