"""CSV and JSON tables, in and out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import extension
from ..functions.masks import is_filled
from ..functions.sql import name
from .csvblocks import has_quoted_newlines, read_records

# Separators a header line may use.
SEPARATORS = (",", ";", "\t", "|")

# Encodings in which quote and newline are single ASCII bytes.
_ASCII_LIKE = ("utf-8", "utf8", "us-ascii", "iso-8859-1", "latin-1", "windows-1252", "cp1252")

# Text no cell holds. With it as the null mark, a quoted empty cell stays text
# and only a cell with nothing at all is NULL.
_NO_TEXT = "\uffff\ufffe\uffff"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs most in the first line; a comma if none does."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def read_csv(spark: SparkSession, path: str, sep: str | None = ",", encoding: str = "UTF-8",
             quoted_newlines: bool | str = "auto", skip_blank_rows: bool = False) -> DataFrame:
    """CSV with a header; every column is a string, missing cells are NULL.

    ``sep=None`` looks at the header line. Files split between tasks whatever they hold: with ``auto``
    a scan looks for a record that spans lines and stops at the first, and files that have some
    are cut block by block. Only encodings whose quotes and line ends aren't single bytes need a task for each file.
    """
    sep = sep or sniff_separator(spark, path)
    splits = encoding.lower() in _ASCII_LIKE
    if quoted_newlines == "auto":
        quoted_newlines = not splits or has_quoted_newlines(spark, path, sep, encoding)
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": _NO_TEXT, "multiLine": str(bool(quoted_newlines)).lower()}
    df = spark.read.options(**options, header=True, encoding=encoding).csv(path)
    if quoted_newlines and splits:
        df = read_records(spark, path, df.schema, options, sep, encoding)
    return drop_blank_rows(df) if skip_blank_rows else df


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Without rows whose cells are all blank."""
    return df.where(F.expr(" OR ".join(f"coalesce({is_filled(f'CAST({name(c)} AS STRING)')}, false)"
                                       for c in df.columns)))


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """CSV with every cell as it is: outer blanks kept, NULL empty, empty text quoted."""
    (df.write.mode(mode).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def is_json_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether the first line with content is a JSON object of its own; arrays and objects over several lines are not."""
    first = (spark.read.option("encoding", encoding).text(path).where(F.col("value").rlike(r"\S")).first())
    if first is None:
        return True
    try:
        return isinstance(json.loads(first[0].lstrip("\ufeff")), dict)
    except ValueError:
        return False


def _whole_value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rests = []
        for text in batch["value"]:
            text = text.lstrip("\ufeff").strip()
            _, end = json.JSONDecoder().raw_decode(text) if text else (None, 0)
            rests.append(text[end:].strip()[:40])
        yield pd.DataFrame({"rest": [r for r in rests if r]}, dtype=str)


def read_json(spark: SparkSession, path: str, lines: bool | None = None, encoding: str = "UTF-8") -> DataFrame:
    """JSON records: one object per line, or an array of objects or a single object per file.

    ``lines=None`` looks at the first line. Lines split between tasks; a file that is one
    value is one record by its format, and an error if more follows that value.
    Anything that is not an object is an error.
    """
    if lines is None:
        lines = is_json_lines(spark, path, encoding)
    reader = spark.read.option("multiLine", not lines).option("encoding", encoding).option("mode", "FAILFAST")
    if not lines:
        whole = spark.read.option("encoding", encoding).text(path, wholetext=True).select("value")
        more = whole.mapInPandas(_whole_value, "rest string").agg(F.min("rest")).first()[0]
        if more is not None:
            raise ValueError(f"content after the first JSON value of a file: {more}")
        # Told the schema by the texts, the reader needs none of its own from the files: for that it would
        # give each file a configuration that names all others.
        texts = whole.rdd.map(lambda r: r["value"])
        reader = reader.schema(spark.read.option("mode", "FAILFAST").json(texts).schema)
    return reader.json(path)


def write_json(df: DataFrame, path: str, sort_keys: bool = False, mode: str = "errorifexists") -> None:
    """One object per line, NULLs included."""
    out = df.select(*[name(c) for c in sorted(df.columns)]) if sort_keys else df
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv_to_json(spark: SparkSession, source: str, target: str, **csv_options) -> None:
    write_json(read_csv(spark, source, skip_blank_rows=True, **csv_options), target)


def json_to_csv(spark: SparkSession, source: str, target: str, lines: bool | None = None, sep: str = ",") -> None:
    df = read_json(spark, source, lines=lines)
    write_csv(df.select(*[F.col(name(c)).cast("string").alias(c) for c in df.columns]), target, sep=sep)


def row_text(columns: list[str]) -> str:
    """A row as one line for scanning: its cells joined by `` | ``."""
    cells = ", ".join(f"coalesce(CAST({name(c)} AS STRING), '')" for c in columns)
    return f"concat_ws(' | ', {cells})"


def table_format(spark: SparkSession, path: str) -> str:
    """``csv``, ``json`` or ``sql``: by suffix, else by the first line."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in (".csv", ".sql", ".json"):
        return suffix[1:]
    first = spark.read.text(path).first()
    start = (first[0] if first else "").strip().upper()
    return "sql" if start.startswith(("INSERT", "--")) else "csv"


def format_column(path: str) -> str:
    """Table format of a path column by suffix, NULL if only the content can tell."""
    ext = f"lower({extension(path)})"
    return f"IF({ext} IN ('.csv', '.sql', '.json'), substr({ext}, 2), NULL)"
