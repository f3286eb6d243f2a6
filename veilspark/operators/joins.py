"""Typed pseudonyms keep equi-joins: checks and value dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import cell_type
from ..functions.masks import mask_full
from ..functions.sql import let, name
from ..session import BROADCAST_ROWS
from .lookup import lookup


def pseudonym(column: str, digits: int = 4) -> str:
    """Irreversible pseudonym of a column; its type is a function of the value."""
    def masked(v: str) -> str:
        return let(f"coalesce({cell_type(v)}, 'generic')", lambda kind: mask_full(v, kind, digits))
    return let(f"CAST({name(column)} AS STRING)", masked)


def join_preservation(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                      digits: int = 4) -> DataFrame:
    """Does a join on pseudonyms equal the join on the raw keys? One row of counts.

    Both sides are counted per key first, map-side, so a key that holds a third
    of the rows is one row when the join starts. ``collisions`` counts distinct
    keys of either side that share a pseudonym with another key.
    """
    def counted(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(F.col(name(key)).alias("raw")).agg(F.count(F.lit(1)).alias("n")) \
            .where("raw IS NOT NULL").withColumn("masked", F.expr(pseudonym("raw", digits)))

    both = counted(left, left_key).select("raw", "masked", F.col("n").alias("l")) \
        .join(counted(right, right_key).select("raw", "masked", F.col("n").alias("r")), ["raw", "masked"], "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per_raw = both.select("masked", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    per_mask = per_raw.groupBy("masked").agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum(F.col("l") * F.col("r")).alias("raw_pairs"),
        F.count(F.lit(1)).alias("keys"))
    return per_mask.agg(
        zero("raw_pairs").alias("raw_rows"), zero(F.col("l") * F.col("r")).alias("masked_rows"),
        zero(F.when(F.col("r") == 0, F.col("l"))).alias("left_only"),
        zero(F.when(F.col("l") == 0, F.col("r"))).alias("right_only"),
        zero(F.col("keys") - 1).alias("collisions"))


def value_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with their PII type, each worked out once."""
    values = df.select(F.col(name(column)).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return values.withColumn("pii_type", F.expr(f"coalesce({cell_type('value')}, 'generic')"))


def with_types(df: DataFrame, column: str, out: str = "pii_type",
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add the PII type of a column through its value dictionary.

    Worth it where values repeat a lot; else use the detector on every row.
    """
    table = value_dictionary(df, column).select(F.col("value").alias("_value"), F.col("pii_type").alias(out))
    keyed = df.withColumn("_value", F.col(name(column)).cast("string"))
    return lookup(keyed, table, "_value", spread_by=df.columns, broadcast_rows=broadcast_rows,
                  materialize=True).drop("_value")
