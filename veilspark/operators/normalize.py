"""Row normalisation and column type inference over text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import strip
from ..functions.sql import name
from ..functions.values import as_double, coerce, kind_of


def lower_names(df: DataFrame) -> DataFrame:
    """Column names in lower case; two that become equal are an error."""
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) < len(lowered):
        raise ValueError(f"column names collide in lower case: {sorted(lowered)}")
    return df.toDF(*lowered)


def normalize_rows(df: DataFrame, columns: Sequence[str] | None = None, strip_cells: bool = True,
                   lowercase_keys: bool = False) -> DataFrame:
    """String columns as tagged values, cell by cell; other columns stay.

    ``kind`` says which of ``b``, ``l``, ``d``, ``s`` holds the value.
    """
    text = set(columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    out = df.select(*[F.expr(coerce(name(c), strip_cells)).alias(c) if c in text else F.col(name(c))
                      for c in df.columns])
    return lower_names(out) if lowercase_keys else out


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: cells of each kind and the narrowest type for all.

    Cells are counted per column map-side; what shuffles is a row per column
    and task.
    """
    columns = list(columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    cells = df.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.expr(strip(f"CAST({name(c)} AS STRING)")).alias("v")) for c in columns])))
    kinds = cells.withColumn("kind", F.expr(kind_of("v")))
    wide = (F.col("kind") == "int") & F.expr("try_cast(v AS BIGINT)").isNull()
    huge = (F.col("kind") == "int") & (F.length("v") > 38)
    counted = kinds.groupBy("column").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("null", "bool", "int", "float", "str")],
        F.count_if(wide).alias("_wide"), F.count_if(huge).alias("_huge"))
    filled = F.col("n_bool") + F.col("n_int") + F.col("n_float") + F.col("n_str")
    kind = (F.when((F.col("n_str") > 0) | (F.col("_huge") > 0) | (filled == 0), "string")
            .when(F.col("n_bool") == filled, "boolean")
            .when(F.col("n_bool") > 0, "string")
            .when(F.col("n_float") > 0, "double")
            .when(F.col("_wide") > 0, "decimal(38,0)").otherwise("bigint"))
    return counted.withColumn("type", kind).drop("_wide", "_huge")


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns in their inferred types; words that mean no value become NULL."""
    def typed(c: str):
        v = strip(name(c))
        if types[c] == "double":
            return F.expr(f"IF({kind_of(v)} IN ('int', 'float'), {as_double(v)}, NULL)")
        target = v if types[c] == "string" else f"try_cast({v} AS {types[c]})"
        return F.expr(f"IF({kind_of(v)} = 'null', NULL, {target})")
    return df.select(*[typed(c).alias(c) if c in types else F.col(name(c)) for c in df.columns])
