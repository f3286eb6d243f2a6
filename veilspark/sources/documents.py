"""Text documents, one row per file, and what goes out after a scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.files import encoding_by_mark, extension, stem
from ..functions.spans import redact
from ..functions.sql import name, struct, transform
from ..operators.inventory import (MAX_FILE_MB, SCANNED_SUFFIXES, decode, guess_encoding, limit_bytes, list_files,
                                   list_folder, local_folder, local_name, scannable)
from ..operators.report import counts_of, value_free


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def _decode(content: pd.Series, marked: pd.Series) -> pd.DataFrame:
    """Encoding and text of bytes; the encoding is found out unless a mark has settled it."""
    encoding = [known or guess_encoding(raw) for raw, known in zip(content, marked)]
    text = [None if raw is None else bytes(raw).decode(enc, errors="replace") for raw, enc in zip(content, encoding)]
    return pd.DataFrame({"encoding": encoding, "text": text}, dtype=object)


#: bytes of content after which a batch of texts leaves Python
BATCH_BYTES = 4 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read and decode the files of status ``read``."""
    def made(rows: pa.RecordBatch, found: list[tuple[str | None, str | None]]) -> pa.RecordBatch:
        encoding, text = zip(*found)
        return pa.RecordBatch.from_pydict({
            "path": rows.column("path"), "length": rows.column("length"), "encoding": pa.array(encoding, pa.string()),
            "text": pa.array(text, pa.string()), "status": rows.column("status")})

    for batch in batches:
        start, size, found = 0, 0, []
        for k, (path, status) in enumerate(zip(batch.column("path").to_pylist(), batch.column("status").to_pylist()), 1):
            if status != "read":
                found.append((None, None))
            else:
                with open(local_name(path), "rb", buffering=0) as file:
                    raw = file.read()
                size += len(raw)
                found.append(decode(raw))
            if size >= BATCH_BYTES or k == batch.num_rows:
                yield made(batch.slice(start, k - start), found)
                start, size, found = k, 0, []


#: Spark counts a file as 4 MB at least and so gives a task 32 small ones; this many of its tasks become one, as
#: long as there are some for each core
TASKS_IN_ONE = 16
TASKS_PER_CORE = 8

#: suffixes of files that hold no plain text
BINARY_SUFFIXES = (".pdf", ".docx", ".xlsx", ".xls")


def read_documents(spark: SparkSession, path: str, max_mb: float | None = None,
                   suffixes: Sequence[str] = SCANNED_SUFFIXES) -> DataFrame:
    """``(path, length, encoding, text, status)`` for every file of a tree with a known suffix.

    Status is ``read``, ``binary format``, or ``too large`` where ``max_mb`` sets a limit; without a
    text the others are still listed, and their content isn't read. Folders of local or mounted file systems are listed
    and read by tasks, once the result is worked out; what only Spark's readers open, and patterns, Spark lists on the driver.
    """
    binary = F.lower(F.expr(extension("path"))).isin(*BINARY_SUFFIXES)
    large = F.lit(False) if max_mb is None else F.col("length") > limit_bytes(max_mb)
    status = F.when(binary, "binary format").when(large, "too large").otherwise("read")
    few = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    folder = local_folder(spark, path)
    if folder is not None:
        files = scannable(list_folder(spark, folder, few), None, suffixes).withColumn("status", status)
        many = max(few, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return files.repartition(many, "lot").mapInArrow(
            _texts, "path string, length bigint, encoding string, text string, status string")
    listed = scannable(list_files(spark, path), None, suffixes)
    tasks = max(listed.select("path").rdd.getNumPartitions() // TASKS_IN_ONE, few)
    left = listed.where(binary | large).select("path", "length", F.lit(None).cast("string").alias("encoding"),
                                               F.lit(None).cast("string").alias("text"), status.alias("status")).coalesce(tasks)
    # UTF-8 files are read inside the JVM; other encodings are found out and decoded in Arrow batches
    files = listed.where(~(binary | large)).coalesce(tasks).withColumn("marked", F.expr(encoding_by_mark("content")))
    utf8 = F.coalesce(F.col("marked") == "utf-8", F.lit(False))
    other = files.withColumn("other", _decode(F.when(~utf8, F.col("content")), F.when(~utf8, F.col("marked"))))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(F.col("other.text"))
    return other.select("path", "length", F.coalesce("marked", "other.encoding").alias("encoding"), text.alias("text"),
                        F.lit("read").alias("status")).union(left)


#: files of a folder that ``write_documents`` makes
FILES_IN_FOLDER = 1000


def write_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """A tree with one UTF-8 file per row, ``<folder>/<key>=<value>_<n>.txt``: the text and a newline, of NULL the newline alone.

    Tasks write their files themselves, through Arrow's file systems (local or mounted folders, HDFS, object stores), and a folder for
    each thousand, so a file costs neither a folder nor a step of the driver. Rows are in order of the key within a
    task; a task that runs again writes the same files again. Rows of the same key have files of their own.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(path)
        n = 0
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/{TaskContext.get().partitionId():05d}-{n // FILES_IN_FOLDER:06d}"
                if n % FILES_IN_FOLDER == 0:
                    files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{key}={k}_{n}.txt") as out:
                    out.write((content or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    files, root = FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)  # there also without rows
    texts = df.select(F.col(name(key)).cast("string"), F.col(name(text)).cast("binary"), F.col(name(key)).alias("_order"))
    texts.sortWithinPartitions("_order").drop("_order").mapInArrow(write, "files bigint").write.format("noop").mode("overwrite").save()


def oversized(files: DataFrame, max_mb: float = MAX_FILE_MB) -> DataFrame:
    """Files a scan refuses for their size, with the size in MB."""
    return files.where(F.col("length") > limit_bytes(max_mb)) \
        .select("path", F.round(F.col("length") / 1048576, 2).alias("size_mb"))


def read_utf8_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of UTF-8 files; the plain text reader, nothing detected."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def redacted_documents(scanned: DataFrame, key: str, text: str = "text", findings: str = "findings",
                       style: str = "block") -> DataFrame:
    """``(key, redacted)`` of the documents in which something was found."""
    return scanned.where(F.size(findings) > 0).select(
        key, F.expr(redact(name(text), name(findings), style)).alias("redacted"))


def redacted_name(path: str) -> str:
    """File name for a redacted copy: ``<stem>_redacted<suffix>``."""
    return f"concat({stem(path)}, '_redacted', {extension(path)})"


def findings_export(scanned: DataFrame, key: str, findings: str = "findings", with_match: bool = False) -> DataFrame:
    """``(key, findings_count, findings, stats)`` for a JSON sink.

    The matched text stays out unless asked for.
    """
    f = name(findings)
    shown = value_free(f) if not with_match else transform(f, lambda x: struct(
        category=f"{x}.category", type=f"{x}.type", match=f"{x}.match", start=f"{x}.start",
        end=f"{x}.`end`", method=f"{x}.method", confidence=f"coalesce({x}.confidence, 1.0D)"))
    return scanned.select(
        key, F.expr(f"size({f})").alias("findings_count"), F.expr(shown).alias("findings"),
        F.struct(F.expr(f"size({f})").alias("total"), F.expr(counts_of(f, "category")).alias("by_category"),
                 F.expr(counts_of(f, "method")).alias("by_method")).alias("stats"))
