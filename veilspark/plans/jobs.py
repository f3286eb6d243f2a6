"""The three jobs end to end: scan documents, scrub a table, recover a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import DELETE, PRESERVE, TOKENIZE
from ..operators.audit import append_audit, scan_audit, scrub_audit
from ..operators.classify import column_labels, sensitive_columns
from ..operators.detect import scan
from ..operators.scrub import observed, plan_levels, scrub
from ..operators.vault import extend_vault, load_vault, open_vault, recover, tokenised_columns, vault_key
from ..policy import DEFAULT_PRESET
from ..sources.documents import redacted_documents
from ..sources.sqldump import read_sql_dump, write_sql_dump
from ..session import checkpoint
from ..sources.tables import read_csv, read_json, table_format, write_csv, write_json


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> tuple[DataFrame, str]:
    """A CSV, JSON or SQL-dump table and its format."""
    fmt = fmt or table_format(spark, path)
    readers = {"csv": read_csv, "json": read_json, "sql": read_sql_dump}
    if fmt not in readers:
        raise ValueError(f"unsupported table format: {fmt}")
    return readers[fmt](spark, path, **options), fmt


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    {"csv": write_csv, "json": write_json, "sql": write_sql_dump}[fmt](df, path)


@dataclass
class ScrubResult:
    total_rows: int = 0
    sensitive_columns: list[str] = field(default_factory=list)
    deleted_columns: list[str] = field(default_factory=list)
    cells_seen: int = 0
    cells_masked: int = 0
    pii_by_column: dict[str, int] = field(default_factory=dict)
    vault_path: str | None = None


def scrub_table(spark: SparkSession, source: str, target: str, preset: str = DEFAULT_PRESET,
                password: str | None = None, fmt: str | None = None, audit_path: str | None = None,
                order_by: str | None = None, sample_rows: int | None = None, digits: int = 4, type_from_column: bool = False,
                levels: dict[str, str] | None = None, vault_path: str | None = None, row_key: str | Sequence[str] = (),
                **read_options) -> ScrubResult:
    """Classify, mask, write, and record what was done.

    Classification reads every row, unless ``sample_rows`` says how many; the scrub itself
    is one map-only pass that counts while it writes. Recoverable tokens need a
    password; their vault is written and checked before any masked row is. It stands at ``target + '.vault'``, or at
    ``vault_path``, which may be there already: then its key is used and only new values are added, so that tables of
    several jobs join on their tokens. Columns named as ``row_key`` are not classified by content, see ``sensitive_columns``.
    A table without sensitive columns is copied as it is, whatever its format.
    ``read_options`` go to the reader; ``quoted_newlines=False`` spares CSV the pass that looks for
    records over several lines.
    """
    df, fmt = read_table(spark, source, fmt, **read_options)
    if levels is None:
        levels = plan_levels(sensitive_columns(df, row_key=row_key, order_by=order_by, sample_rows=sample_rows), preset)
    key = None
    if TOKENIZE in levels.values():
        if not password:
            raise ValueError("this preset tokenises: pass a password")
        vault_path = vault_path or target + ".vault"
        key = vault_key(spark, vault_path, password)
        extend_vault(df, tokenised_columns(levels), vault_path, key)
    metrics = Observation()
    masked = scrub(observed(df, levels, metrics), levels, key.token if key else None, digits,
                   type_from_column=type_from_column)
    write_table(masked, target, fmt)
    counts = dict(metrics.get)
    rows = counts.pop("_rows")
    result = ScrubResult(
        rows, [c for c in df.columns if c in levels], [c for c in df.columns if levels.get(c) == DELETE],
        sum(counts.values()), sum(n for c, n in counts.items() if levels[c] != PRESERVE), counts)
    if key:
        result.vault_path = vault_path
    if audit_path:
        append_audit(scrub_audit(
            spark, input_file=source, output_file=target, table_format=fmt, preset=preset,
            total_rows=rows, total_columns=len(df.columns), pii_by_column=counts,
            labels=column_labels(df, list(levels))), audit_path)
    return result


def recover_table(spark: SparkSession, source: str, target: str, password: str, fmt: str | None = None,
                  vault_path: str | None = None, row_key: Sequence[str] | None = None) -> dict[str, int]:
    """Undo tokenisation with the vault; a wrong password fails before anything is written."""
    df, fmt = read_table(spark, source, fmt)
    vault, key = load_vault(spark, vault_path or source + ".vault", password)
    restored = recover(df, open_vault(vault, key), row_key=row_key)
    metrics = Observation()
    counted = restored.observe(metrics, F.count(F.lit(1)).alias("total_rows"),
                               F.coalesce(F.sum("recovered_cells"), F.lit(0)).alias("recovered_cells"))
    write_table(counted.drop("recovered_cells"), target, fmt)
    return dict(metrics.get)


def scan_documents(documents: DataFrame, key: str, text: str = "text", style: str | None = None,
                   redacted_path: str | None = None, audit_path: str | None = None) -> DataFrame:
    """Documents with their findings; on request also redacted copies and audit records, from one scan.

    With either, scanned documents are first written to the shared folder.
    """
    scanned = scan(documents, text)
    if redacted_path or audit_path:
        scanned = checkpoint(scanned)
    if redacted_path:
        redacted_documents(scanned, key, text, style=style or "block").write.parquet(redacted_path)
    if audit_path:
        append_audit(scan_audit(scanned, key, text, style=style or "block"), audit_path)
    return scanned
