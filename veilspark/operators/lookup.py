"""Left join against a table with one row per key, safe under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import name
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, checkpoint

#: a key with up to so many rows fits one task comfortably; one with more gets a task for each so many
HOT_ROWS = 1_000_000
#: tasks rows without a key are spread over; they match nothing
NULL_SALTS = 64


def _width(field: T.StructField) -> Column:
    """Bytes of a column's value: of texts and binaries as they are, of nested values as JSON, of others eight."""
    column = F.col(name(field.name))
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column.alias("v")))), F.lit(0)).cast("bigint")
    return F.lit(8).cast("bigint")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small in rows and in bytes; looks at one row more than allowed."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def lookup(left: DataFrame, table: DataFrame, key: str, spread_by: Sequence[str] | None = None,
           broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS,
           materialize: bool = False, counts: str | None = None) -> DataFrame:
    """Add the columns of ``table`` to ``left`` by key; rows without a match get NULLs.

    ``table`` has at most one row per key. Up to ``broadcast_rows`` it is
    broadcast. Beyond, both sides shuffle; keys that hold more than ``hot_rows``
    rows of ``left`` (and NULL keys, which match nothing) are salted, and their
    table rows repeated once per salt. The salt comes from ``spread_by``, best a
    unique row key, so a task that runs again gives the same rows again.
    ``materialize`` writes a computed table to the shared folder before it is
    counted and joined, so it is worked out once. ``counts`` names a column of
    table that has the number of rows of left per key, if there is one.
    """
    if materialize:
        table = checkpoint(table)
    if fits_broadcast(table, broadcast_rows):
        return left.join(F.broadcast(table), key, "left")
    return salted_lookup(left, table, key, spread_by, hot_rows, counts)


def salted_lookup(left: DataFrame, table: DataFrame, key: str, spread_by: Sequence[str] | None = None,
                  hot_rows: int = HOT_ROWS, counts: str | None = None) -> DataFrame:
    """The lookup for tables too large to broadcast.

    Hot keys go by a hash of the key, so the list of them stays narrow however long keys are.
    """
    of_key = F.xxhash64(key)
    per_key = (table.select(of_key.alias("_hash"), F.col(counts).alias("_n")) if counts else
               left.where(F.col(key).isNotNull()).select(of_key.alias("_hash"), F.lit(1).alias("_n")))
    hot = checkpoint(per_key.groupBy("_hash").agg(F.sum("_n").alias("_n")).where(F.col("_n") > hot_rows)
                     .select("_hash", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    spread = F.pmod(F.xxhash64(*(spread_by or left.columns)),
                    F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(salts)).cast("int")
    salted = left.withColumn("_hash", of_key).join(hot, "_hash", "left").withColumn("_salt", spread).drop("_hash", "_salts")
    repeated = (table.withColumn("_hash", of_key).join(hot, "_hash", "left")
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hash", "_salts"))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
