"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import fits_broadcast

# ASCII letters, for lower-casing A-Z and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: a word is a run of characters other than ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_row_key(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the join key (_k1, _k2) of a row: its id and a hash of id and text.

    A row without an id has a key too. Rows equal in id and text share one key
    and so one result. Two texts of one id stay apart but for a 64-bit collision
    among the texts of that id.
    """
    lowest = F.lit(-(1 << 63)).cast("bigint")
    return df.withColumns({"_k1": F.coalesce(F.col(key).cast("bigint"), lowest),
                           "_k2": F.xxhash64(F.col(key), F.col(text))})


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns, and the whole row as ``_row``, safe from columns an operator adds or drops."""
    return df.select(*(F.col(f"`{c}`") for c in columns), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns, in whatever case, whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in taken))


def small(df: DataFrame) -> DataFrame:
    """The table with a hint to broadcast it, if a look at its rows and bytes allows that."""
    return F.broadcast(df) if fits_broadcast(df) else df


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not every C library has it
        return lambda _: 0


def give_back() -> None:
    """At the end of a Python task: memory that is free goes back to the machine, for the process lives on to other stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
