"""CSV whose records may span lines, read by as many tasks as its files have blocks.

A line break inside quotes belongs to a cell, so where a record ends depends on all that came
before. A first pass reads the lines that have quotes and works out, for each block of a file, in
which state it leaves a reader that comes in outside quotes, and one that comes in inside. From that follows
the state each block begins in, and a second pass cuts all blocks by themselves. What a block
ends or leaves open is put together with its neighbours' ends; Spark's own parser takes the records apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import lit

PIECE = "file string, block long, kind int, piece string"
#: what a piece is: the end of a record begun earlier, a record, a record left open, or a block with no end in it
ENDS, RECORD, OPEN, THROUGH = 0, 1, 2, 3
#: records given away at once
AT_ONCE = 4096


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a reader is inside quotes after a line. Quotes open a cell only where it begins; doubled ones are text."""
    at = 0
    if not inside and not line.startswith('"'):
        at = line.find(sep + '"') + 1
        if at == 0:
            return False
    while True:
        if not inside:  # at the quote that opens a cell
            inside, at = True, at + 1
        close = line.find('"', at)
        if close < 0:
            return True
        if line.startswith('"', close + 1):
            at = close + 2
            continue
        inside = False
        at = line.find(sep, close + 1) + 1
        if at == 0:
            return False
        if not line.startswith('"', at):
            at = line.find(sep + '"', at) + 1
            if at == 0:
                return False


def spans_lines(line: str, sep: str) -> str:
    """SQL expression: whether a line that begins outside quotes ends inside them."""
    s = "\\" + sep if sep != "\t" else "\\t"
    closed = f'^(?:(?:"(?:[^"]++|"")*+"[^{s}]*+|[^{s}"][^{s}]*+)?(?:{s}|$))*+$'
    return f"contains({line}, '\"') AND NOT {line} RLIKE {lit('(?s)' + closed)}"


def lines_of(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").option("encoding", encoding).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def has_quoted_newlines(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> bool:
    """Whether some record spans lines. Stops at the first; files without one can be split at any line."""
    return not lines_of(spark, path, encoding).where(F.expr(spans_lines("rtrim('\\r', value)", sep))).isEmpty()


def _states(sep: str):
    """(file, block, from_outside, from_inside) of blocks by their lines that have quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = found.setdefault((file, block), [False, True])
                a, b = state
                state[0] = inside_after(line, a, sep)
                state[1] = state[0] if a == b else inside_after(line, b, sep)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((*k, *v) for k, v in found.items()), strict=True)],
                                             ["file", "block", "from_outside", "from_inside"])
    return run


def begun_inside(lines: DataFrame, sep: str) -> dict[str, set[int]]:
    """Per file the blocks that begin inside quotes: all the driver needs, a number for each such block.

    A block of constant effect settles the state whatever came before; the others keep or flip it. So the state after a
    block is that of the last constant one, flipped as often as blocks after it flip.
    """
    states = (lines.where(F.col("value").contains('"')).mapInArrow(_states(sep), "file string, block long, from_outside boolean, from_inside boolean")
              .groupBy("file", "block").agg(F.max("from_outside").alias("a"), F.max("from_inside").alias("b")))  # a block is one task's
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    flip = (F.col("a") & ~F.col("b")).cast("int")
    told = (states.withColumn("flips", F.sum(flip).over(order))
            .withColumn("base", F.max(F.when(F.col("a") == F.col("b"), F.struct("block", F.col("a").cast("int").alias("to"), "flips"))).over(order))
            .withColumn("inside", F.pmod(F.coalesce(F.col("base.to") + F.col("flips") - F.col("base.flips"), F.col("flips")), F.lit(2)) == 1))
    # blocks without quotes have no row: the state they begin in holds on behind them
    blocks = lines.select("file", "block").distinct().join(told.select("file", "block", "inside"), ["file", "block"], "left")
    before = F.last("inside", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    found: dict[str, set[int]] = {}
    for r in blocks.withColumn("begun", before).where("begun").select("file", "block").toLocalIterator():
        found.setdefault(r["file"], set()).add(r["block"])
    return found


def _cut(begun: Mapping[str, set[int]], sep: str, header: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, parts, kind, heading, out = None, False, [], RECORD, False, []

        def give() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["file", "block", "kind", "piece"])
            out.clear()
            return made

        def leave() -> None:
            if parts:
                out.append((*now, OPEN if kind == RECORD else THROUGH, "\n".join(parts)))

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != now:
                    leave()
                    now, parts = (file, block), []
                    inside = block in begun.get(file, ())
                    kind, heading = ENDS if inside else RECORD, header and block == 0
                    line = line.removeprefix("﻿") if block == 0 else line
                if '"' in line:
                    inside = inside_after(line, inside, sep)
                parts.append(line)
                if not inside:
                    record = ("\n".join(parts) if len(parts) > 1 else line).removesuffix("\r")
                    if heading:
                        heading = not record.strip()  # the first line that isn't blank
                    elif kind == ENDS or record.strip():
                        out.append((file, block, kind, record))
                    parts, kind = [], RECORD
                    if len(out) >= AT_ONCE:
                        yield give()
        leave()
        if out:
            yield give()
    return run


def records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """(record): whole records of all files, without the header lines; every block of a file is a task's own work."""
    lines = lines_of(spark, path, encoding)
    pieces = lines.mapInArrow(_cut(begun_inside(lines, sep), sep, header), PIECE)
    edges = pieces.where(F.col("kind") != RECORD)
    earlier = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == ENDS, 0).otherwise(1))
    numbered = edges.withColumn("n", F.sum(F.when(F.col("kind") == ENDS, 1).otherwise(0)).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    stitched = (numbered.groupBy("file", F.coalesce("n", F.lit(0)).alias("n"))
                .agg(F.sort_array(F.collect_list(F.struct("block", (F.col("kind") != ENDS).alias("open"), "piece"))).alias("all"))
                .select(F.array_join("all.piece", "\n").alias("record")))
    return pieces.where(F.col("kind") == RECORD).select(F.col("piece").alias("record")).union(stitched)


def read_records(spark: SparkSession, path: str, columns: T.StructType, options: Mapping[str, str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The records as rows of string columns, taken apart by Spark's CSV parser."""
    parsed = F.from_csv("record", ", ".join(f"`{f.name.replace('`', '``')}` string" for f in columns), dict(options))
    return records(spark, path, sep, encoding).select(parsed.alias("_r")).select("_r.*")
