"""Which columns of a table are sensitive."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.celltypes import typer
from ..functions.detectors import cell_type, has_pii
from ..functions.masks import is_filled
from ..functions.sql import name
from ..patterns import PATTERNS, SPACES, Pattern
from ..policy import is_sensitive_name

# Share of matching cells that makes a column sensitive, rows
# sampled for it, and rows looked at for a representative type.
THRESHOLD = 0.3
SAMPLE_ROWS = 100
TYPE_ROWS = 10

# A number of a row, and how many numbers up to the largest there may be for each that occurs.
_ROW_NUMBER = r"\A(?:0|[1-9][0-9]{0,17})\z"
NUMBERS_EACH = 2
# Numbers of a block, one bit each, and how long the first run of numbers is at least, for an average of one.
BLOCK = 50
FIRST_RUN = 0.9


def _nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def first_rows(df: DataFrame, rows: int, order_by: str | Sequence[str] | None) -> DataFrame:
    """The first rows by a key, or as the source delivers them, numbered by ``_row``.

    With a key, a first pass over that column alone finds the largest key in
    the sample; the second pass pushes it down, so a clustered file gives up
    only a few row groups.
    """
    if order_by is None:
        return df.limit(rows).withColumn(
            "_row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    key = F.col(keys[0])
    bound = df.select(key).orderBy(key).limit(rows).agg(F.max(key)).first()[0]
    near = df if bound is None else df.where(key.isNull() | (key <= F.lit(bound)))
    head = near.orderBy(*keys).limit(rows)
    return head.withColumn("_row", F.row_number().over(Window.orderBy(*keys)))


def classify(df: DataFrame, order_by: str | Sequence[str] | None = None, sample_rows: int | None = None,
             threshold: float = THRESHOLD, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """One row per column: hits, filled cells, hit rate, sensitive or not, PII type.

    A column is sensitive if its name says so, or if the share of filled cells
    with a finding reaches the threshold. Columns known by name are looked at
    for their type only; nested columns count as clean. Every row counts. The
    type is that of most cells, of equally frequent ones the first in the registry,
    and ``mixed`` if no cell has one.

    ``sample_rows`` looks at the first rows only, by ``order_by`` or as the source
    delivers them; the type is then that of the first filled cell.
    """
    columns = [f for f in df.schema.fields if not _nested(f.dataType)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, by_name boolean, hits bigint, "
                                               "filled bigint, rate double, sensitive boolean, pii_type string")
    narrow = df.select([f.name for f in columns])
    counted = (_count_all(narrow, columns, patterns) if sample_rows is None
               else _count_sample(first_rows(narrow, sample_rows, order_by), columns, patterns))
    rate = F.when(F.col("by_name") | (F.col("filled") == 0), 0.0).otherwise(F.col("hits") / F.col("filled"))
    judged = counted.withColumn("rate", rate).withColumn(
        "sensitive", F.col("by_name") | ((F.col("filled") > 0) & (F.col("rate") >= threshold)))
    kind = F.when(F.col("sensitive"), F.coalesce("kind", F.lit("mixed"))).otherwise("-")
    return judged.withColumn("pii_type", kind).orderBy("position").select(
        "column", "by_name", "hits", "filled", "rate", "sensitive", "pii_type")


def _cells(rows: DataFrame, columns: Sequence[T.StructField], *more: str) -> DataFrame:
    return rows.select(*more, F.inline(F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(i).alias("position"),
        F.lit(is_sensitive_name(f.name)).alias("by_name"),
        F.col(name(f.name)).cast("string").alias("raw")) for i, f in enumerate(columns)])))


def _filled():
    return F.expr(f"coalesce({is_filled('raw')}, false)")


def _count_all(rows: DataFrame, columns: Sequence[T.StructField], patterns: Sequence[Pattern]) -> DataFrame:
    """Counts per column and type. Tasks count their own cells; what moves is a row per column, type and task."""
    chosen, n = tuple(patterns), len(columns)
    blank = re.compile(f"[{''.join(SPACES)}]*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = typer(chosen)
        filled, total = np.zeros((n, len(chosen) + 1), np.int64), np.zeros((n, len(chosen) + 1), np.int64)
        for batch in batches:
            for i in range(n):
                values, codes, ranks = types(batch.column(i))
                each = np.bincount(codes.drop_null().to_numpy(), minlength=len(values))
                some = np.fromiter((blank.fullmatch(v) is None for v in values.to_pylist()), bool, len(values))
                np.add.at(total[i], ranks, each)
                np.add.at(filled[i], ranks, each * some)
        at = np.argwhere(total).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[total > 0]), pa.array(filled[total > 0])],
                                         ["position", "rank", "n", "filled"])

    cells = rows.select(*[F.col(name(f.name)).cast("string").alias(f"c{i}") for i, f in enumerate(columns)])
    per_type = cells.mapInArrow(count, "position int, rank int, n bigint, filled bigint").groupBy("position", "rank").agg(
        F.sum("n").alias("n"), F.sum("filled").alias("filled"))
    typed = F.col("rank") < len(chosen)
    per_column = per_type.groupBy("position").agg(
        F.sum(F.when(typed, F.col("n")).otherwise(0)).alias("found"), F.sum("filled").alias("filled"),
        F.max_by("rank", F.when(typed, F.struct("n", (-F.col("rank")).alias("r")))).alias("rank"))
    known = rows.sparkSession.createDataFrame(
        [(i, f.name, is_sensitive_name(f.name)) for i, f in enumerate(columns)], "position int, column string, by_name boolean")
    names = F.array(*[F.lit(p.type) for p in chosen])
    return known.join(per_column, "position", "left").select(
        "column", "position", "by_name", F.when(F.col("by_name"), 0).otherwise(F.coalesce("found", F.lit(0))).cast("bigint").alias("hits"),
        F.coalesce("filled", F.lit(0)).alias("filled"), F.get(names, F.col("rank")).alias("kind"))


def _count_sample(rows: DataFrame, columns: Sequence[T.StructField], patterns: Sequence[Pattern]) -> DataFrame:
    example = F.min_by("raw", F.when(_filled() & (F.col("_row") <= TYPE_ROWS), F.col("_row")))
    return _cells(rows, columns, "_row").groupBy("column", "position", "by_name").agg(
        F.count_if(F.expr(f"NOT by_name AND {has_pii('raw', patterns)}")).alias("hits"),
        F.count_if(_filled()).alias("filled"), example.alias("example")).withColumn(
        "kind", F.expr(cell_type("example", patterns)))


def numbering_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of some columns that number the rows: 1, 2, 3 and so on, in any order.

    Every filled cell is a whole number without a sign or leading zeros. Either at least half of all numbers up to the
    largest occur, and a number stands in two rows on average at most. Or the numbers begin at the lowest and go on in runs,
    with jumps between them, as sequences of several sources or references to numbered rows do: from the first to the last number
    of every run, fifty at least, half of the numbers occur, and the run from the lowest on is no shorter than nine tenths of the average.
    Such a number tells a row by its place and nothing
    else, although many of them look like zip codes, passports or phones by their length. Zip codes, phone, passport or card
    numbers are too sparse, or have no such beginning, to be taken for one. Every row counts; only columns of numbers that are small for
    their number of rows, or begin at the lowest, go through the count of blocks, which shuffles one row per block and task.
    """
    texts = {c: F.col(name(c)).cast("string") for c in columns}
    filled = {c: F.expr(f"coalesce({is_filled(f'CAST({name(c)} AS STRING)')}, false)") for c in columns}
    if not columns:
        return set()
    numbers = {c: F.when(texts[c].rlike(_ROW_NUMBER), texts[c].cast("bigint")) for c in columns}
    seen = df.agg(*[F.struct(F.count_if(filled[c]).alias("n"), F.count_if(filled[c] & ~texts[c].rlike(_ROW_NUMBER)).alias("others"),
                             F.min(numbers[c]).alias("least"), F.max(numbers[c]).alias("most")).alias(f"c{i}")
                    for i, c in enumerate(columns)]).first()
    found = set()
    for c, r in zip(columns, seen, strict=True):
        if r["n"] and not r["others"] and (r["most"] <= NUMBERS_EACH * r["n"] or r["least"] <= 1):
            b = _blocks(df.where(filled[c]).select(numbers[c].alias("number")))
            small = max(r["most"], r["n"]) <= NUMBERS_EACH * b["numbers"]
            in_runs = (r["least"] <= 1 and b["span"] <= NUMBERS_EACH * b["numbers"]
                       and max(b["first_end"] - r["least"] + 1, BLOCK) * b["runs"] >= FIRST_RUN * b["span"])
            if small or in_runs:
                found.add(c)
    return found


def _blocks(numbers: DataFrame):
    """One row: distinct numbers, runs of blocks one after another, numbers they span, and the last number of the first run.

    A run spans what lies between its first and last number, wherever blocks begin, but a run of one block all of that block.
    """
    per_block = numbers.groupBy(F.expr(f"number div {BLOCK}").alias("block")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(number % {BLOCK} AS INT))")).alias("bits"),
        F.min("number").alias("low"), F.max("number").alias("high"))
    # each block also reports to those before and after it
    none = [F.lit(None).cast("bigint").alias(c) for c in ("bits", "low", "high")]
    near = per_block.select(F.inline(F.array(
        F.struct("block", "bits", "low", "high", F.lit(0).alias("side")),
        F.struct((F.col("block") + 1).alias("block"), *none, F.lit(-1).alias("side")),
        F.struct((F.col("block") - 1).alias("block"), *none, F.lit(1).alias("side")))))
    known = near.groupBy("block").agg(*[F.max(c).alias(c) for c in ("bits", "low", "high")],
                                      (F.min("side") == -1).alias("before"), (F.max("side") == 1).alias("after")).where("bits IS NOT NULL")
    start, end = F.col("after") & ~F.col("before"), F.col("before") & ~F.col("after")
    unused = (F.when(start, F.col("low") % BLOCK).when(end, BLOCK - 1 - F.col("high") % BLOCK).otherwise(0))
    return known.agg(F.sum(F.bit_count("bits")).alias("numbers"), F.count_if(~F.col("before")).alias("runs"),
                     F.sum(F.lit(BLOCK) - unused).alias("span"), F.min(F.when(~F.col("after"), F.col("high"))).alias("first_end")).first()


def sensitive_columns(df: DataFrame, row_key: str | Sequence[str] = (), **options) -> list[str]:
    """Names of the sensitive columns, in table order. Collects one row per column.

    Columns whose names say it are not looked at, so a columnar source never reads them. Columns that
    number the rows are not sensitive, whatever their numbers look like to ``classify``: masked, rows would lose
    their identity and nobody gain privacy. Nor are columns that the caller names as ``row_key``: numbers that don't begin at
    the lowest can't be told from phones or passports, so only the caller knows. A name that says it goes before that.
    """
    found = {c for c in df.columns if is_sensitive_name(c) and not _nested(df.schema[c].dataType)}
    order = options.get("order_by") or ()
    keys = {order} if isinstance(order, str) else set(order)
    known = found | ({row_key} if isinstance(row_key, str) else set(row_key))
    rest = df.select([name(c) for c in df.columns if c not in known or c in keys])
    if set(rest.columns) - known:
        by_content = {r["column"] for r in classify(rest, **options).where("sensitive").select("column").collect()} - known
        found |= by_content - numbering_columns(rest, sorted(by_content))
    return [c for c in df.columns if c in found]


def column_labels(df: DataFrame, sensitive: Sequence[str]) -> dict[str, str]:
    """Column to SENSITIVE or clean, as audit records show it."""
    return {c: "SENSITIVE" if c in set(sensitive) else "clean" for c in df.columns}
