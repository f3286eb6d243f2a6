"""Masking whole tables by policy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.celltypes import cell_ranks, type_name
from ..functions.detectors import scan_text
from ..functions.masks import DELETE, PRESERVE, TOKENIZE, apply_mask, is_filled
from ..functions.spans import redact
from ..functions.sql import let, lit, name, struct, transform
from ..policy import DEFAULT_PRESET, NAME_TYPES, masking_level


def plan_levels(sensitive: Iterable[str], preset: str | dict[str, str] = DEFAULT_PRESET) -> dict[str, str]:
    """Masking level of every sensitive column."""
    return {c: masking_level(c, preset) for c in sensitive}


def scrub(df: DataFrame, levels: dict[str, str], token_key: str | None = None, digits: int = 4,
          token_digits: int = 24, type_from_column: bool = False,
          span_style: str | None = None) -> DataFrame:
    """Mask the columns named in ``levels``; all others pass through untouched.

    A cell is masked as a whole, by the type detected in it or as ``generic``.
    NULL and blank cells stay as they are; masked columns become strings. With
    ``type_from_column`` a cell without a detected type takes the one its
    column name stands for. With ``span_style`` only the detected spans are
    redacted, in that style. Narrow: no shuffle. Cells are typed in Arrow batches, where a value
    that repeats is typed once; masking is one projection.

    All columns of one level share one expression over an array of their cells,
    so the plan does not grow with the width of the table. (Expressions of their
    own for each column would outgrow what the JVM compiles in one method.)
    """
    if TOKENIZE in levels.values() and not token_key:
        raise ValueError("tokenising needs a key: pass a password")
    deleted = [c for c, level in levels.items() if level == DELETE]
    kept = [c for c in df.columns if c not in deleted]
    work = [c for c in kept if levels.get(c, PRESERVE) not in (PRESERVE, DELETE)]
    fallback = {c: lit(NAME_TYPES.get(c.lower(), "generic") if type_from_column else "generic") for c in work}

    def masked(v: str, kind: str, level: str) -> str:
        return apply_mask(v, kind, level, token_key, digits, token_digits) or v

    if not work:
        return df.select(*map(name, kept))
    groups: dict[str, list[str]] = defaultdict(list)
    for c in work:
        groups[levels[c]].append(c)
    out, found = df, {}
    if not span_style:
        out = df.withColumn("_ranks", cell_ranks([F.col(name(c)).cast("string") for c in work]))
    rank = {c: "CAST(NULL AS TINYINT)" if span_style else f"_ranks.c{i}" for i, c in enumerate(work)}
    for n, (level, columns) in enumerate(sorted(groups.items())):
        def mask(cell: str, level: str = level) -> str:
            v = f"{cell}.v"
            if span_style:
                body = redact(v, scan_text(v), span_style)
            else:
                body = let(f"coalesce({type_name(f'{cell}.rank')}, {cell}.fallback)", lambda kind: masked(v, kind, level))
            return f"IF({is_filled(v)}, {body}, {v})"
        cells = ", ".join(struct(v=f"CAST({name(c)} AS STRING)", rank=rank[c], fallback=fallback[c]) for c in columns)
        out = out.withColumn(f"_masked_{n}", F.expr(transform(f"array({cells})", mask)))
        found.update({c: f"get(_masked_{n}, {i})" for i, c in enumerate(columns)})
    return out.select(*[F.expr(found.get(c, name(c))).alias(c) for c in kept])


def _filled_counts(columns: Iterable[str]):
    return [F.count_if(F.expr(is_filled(f"CAST({name(c)} AS STRING)"))).alias(c) for c in columns]


def scrub_counts(df: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Per sensitive column that stays: its level, filled cells seen, and cells masked."""
    stay = [c for c in df.columns if c in levels and levels[c] != DELETE]
    if not stay:
        return df.sparkSession.createDataFrame(
            [], "column string, level string, cells_seen bigint, cells_masked bigint")
    one = df.agg(*_filled_counts(stay))
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(levels[c]).alias("level"), F.col(name(c)).alias("cells_seen"),
        (F.lit(0).cast("bigint") if levels[c] == PRESERVE else F.col(name(c))).alias("cells_masked"))
        for c in stay])
    return one.select(F.inline(rows))


def scrub_summary(df: DataFrame, levels: dict[str, str]) -> DataFrame:
    """One row: rows, columns kept, sensitive and deleted columns, cells seen and masked."""
    stay = [c for c in df.columns if c in levels and levels[c] != DELETE]
    changed = [c for c in stay if levels[c] != PRESERVE]
    deleted = [c for c in df.columns if levels.get(c) == DELETE]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *_filled_counts(stay))
    total = lambda cs: sum((F.col(name(c)) for c in cs), F.lit(0).cast("bigint"))
    return one.select(
        F.col("_rows").alias("total_rows"),
        F.lit(len(df.columns) - len(deleted)).alias("total_columns"),
        F.lit(len(levels)).alias("sensitive_columns"), F.lit(len(deleted)).alias("deleted_columns"),
        total(stay).alias("cells_seen"), total(changed).alias("cells_masked"))


def observed(df: DataFrame, levels: dict[str, str], metrics: Observation | str) -> DataFrame:
    """Count rows and filled cells of ``df`` while another job reads it; no extra pass."""
    stay = [c for c in df.columns if c in levels and levels[c] != DELETE]
    return df.observe(metrics, F.count(F.lit(1)).alias("_rows"), *_filled_counts(stay))
