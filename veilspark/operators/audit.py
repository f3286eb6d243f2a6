"""Value-free records of what a run found or masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import filename
from ..functions.sql import name
from .report import counts_of, method_label, value_free


def scan_audit(scanned: DataFrame, file: str, text: str = "text", findings: str = "findings",
               style: str = "block", at: Column | None = None) -> DataFrame:
    """One audit record per document with findings. The matched text is not in it."""
    f = name(findings)
    return scanned.where(F.size(findings) > 0).select(
        (at if at is not None else F.current_timestamp()).alias("timestamp"),
        F.col(file).cast("string").alias("file"), F.lit(style).alias("redaction_style"),
        F.expr(f"size({f})").alias("total_findings"),
        F.expr(counts_of(f, "category")).alias("by_category"),
        F.expr(counts_of(f, "method")).alias("by_method"),
        F.coalesce(F.length(text), F.lit(0)).alias("scanned_chars"),
        F.expr(value_free(f)).alias("findings"))


def scrub_audit(spark: SparkSession, *, input_file: str, output_file: str, table_format: str, preset: str,
                total_rows: int, total_columns: int, pii_by_column: dict[str, int],
                labels: dict[str, str]) -> DataFrame:
    """The audit record of one scrub run, as a one-row table."""
    row = (input_file, output_file, table_format, preset, total_rows, total_columns,
           list(pii_by_column), sum(pii_by_column.values()), pii_by_column, labels)
    return spark.createDataFrame([row], (
        "input_file string, output_file string, format string, preset string, total_rows bigint, "
        "total_columns int, sensitive_columns array<string>, total_cells_scrubbed bigint, "
        "pii_by_column map<string,bigint>, column_classification map<string,string>")) \
        .select(F.current_timestamp().alias("timestamp"), "*")


def append_audit(records: DataFrame, path: str) -> None:
    """Append records to an audit table partitioned by date."""
    records.withColumn("date", F.to_date("timestamp")) \
        .withColumn("audit_id", F.expr("uuid()")) \
        .write.mode("append").partitionBy("date").parquet(path)


# Fixed value: fields of an audit record kept as JSON.
JSON_RECORD = ("timestamp string, file string, redaction_style string, total_findings bigint, "
               "by_category map<string,bigint>, by_method map<string,bigint>, scanned_chars bigint")


def _record(value: str, log: Column) -> list[Column]:
    r = F.from_json(value, JSON_RECORD)
    good = r["timestamp"].isNotNull()
    return [F.to_timestamp(r["timestamp"]).alias("timestamp"), F.when(good, r["file"]).otherwise(log).alias("file"),
            F.when(good, r["total_findings"].cast("string")).otherwise("?").alias("total_findings"),
            F.when(good, r["by_method"]).alias("by_method"), good.alias("readable")]


def read_audit_files(spark: SparkSession, path: str) -> DataFrame:
    """Audit records kept as one JSON file per run; unreadable files show as ``?``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="audit_*.json", recursiveFileLookup=True)
    return files.select(*_record("value", F.expr(filename("_metadata.file_path"))))


def write_audit_logs(records: DataFrame, path: str, mode: str = "append") -> None:
    """Audit records as JSON lines, one file per task, in folders by date."""
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("date")
    text = F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                              *[F.col(name(c)) for c in records.columns if c != "timestamp"]))
    records.select(text.alias("value"), day).write.mode(mode).partitionBy("date").text(path)


def read_audit_logs(spark: SparkSession, path: str) -> DataFrame:
    """Audit records of JSON lines, with the date of their folder; a line that can't be read shows as ``?``."""
    lines = spark.read.text(path)
    return lines.where("trim(value) <> ''").select(*_record("value", F.lit("?")), F.col("date").cast("date").alias("date"))


def recent_audits(records: DataFrame, n: int = 10) -> DataFrame:
    """The newest n records with their detectors, and how many there are in all.

    Of a table by date only the newest days are read, as many as hold n records; the others are counted, and of a Parquet
    table that takes no more than its footers.
    """
    if "date" in records.columns:
        per_day = records.groupBy("date").agg(F.count(F.lit(1)).alias("n"))  # one row per day
        days = sorted(((r["date"], r["n"]) for r in per_day.collect() if r["date"] is not None), reverse=True)
        total, seen, first = F.lit(sum(d[1] for d in days)).cast("bigint"), 0, None
        for day, count in days:
            if seen >= n:
                break
            seen, first = seen + count, day
        if first is not None:
            records = records.where(F.col("date") >= F.lit(first))
    else:
        total = records.agg(F.count(F.lit(1))).scalar()
    newest = records.orderBy(F.desc("timestamp"), "file").limit(n)
    return newest.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.expr(filename("file")).alias("file"), "total_findings",
        F.expr(f"coalesce({method_label('by_method')}, '?')").alias("method"),
        total.alias("of_total"))


def by_method(records: DataFrame) -> DataFrame:
    """Records and findings per combination of detectors."""
    return records.groupBy(F.expr(method_label("by_method")).alias("method")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("total_findings").alias("findings"))
