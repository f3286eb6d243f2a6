"""Long texts as overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import scan_text, shift
from ..functions.spans import resolve_overlaps, sort_findings
from ..functions.sql import filter_, lit, name, struct, transform
from ..patterns import PATTERNS
from .detect import explode_findings

# Chunk length and overlap in characters, for a contextual
# detector and for reading very long texts.
CHUNK, OVERLAP = 2000, 200
READ_CHUNK, READ_OVERLAP = 10_485_760, 200


def fixed_chunks(text: str, size: int = READ_CHUNK, overlap: int = READ_OVERLAP) -> str:
    """Chunks of equal stride as ``array<struct<start, text>>``; the last one ends the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk")
    stride = size - overlap
    last = f"CAST(greatest(ceil((length({text}) - {size}) / {stride}), 0) AS INT)"
    return transform(f"sequence(0, {last})", lambda i: struct(
        start=f"{i} * {stride}", text=f"substr({text}, {i} * {stride} + 1, {size})"))


def owned_chunks(text: str, size: int = READ_CHUNK, margin: int = READ_OVERLAP) -> str:
    """Chunks as ``array<struct<start, text, own_from, own_to>>``, each with a margin on both sides.

    Every character is owned by one chunk. The margins let matches near a seam see what a
    scan of the whole text sees there; the right one goes on to the next white space, so that no
    long word is cut.
    """
    if not 0 <= margin <= size:
        raise ValueError("the margin must not exceed the chunk")
    last = f"CAST(greatest(ceil(length({text}) / {size}D) - 1, 0) AS INT)"

    def chunk(i: str) -> str:
        end = f"(({i} + 1) * {size} + {margin})"
        more = f"length(coalesce(regexp_substr(substr({text}, {end} + 1, {size}), {lit(chr(94) + chr(92) + 'S+')}), ''))"
        start = f"greatest({i} * {size} - {margin}, 0)"
        return struct(start=start, text=f"substr({text}, {start} + 1, {end} - {start} + {more})",
                      own_from=f"{i} * {size}", own_to=f"({i} + 1) * {size}")
    return transform(f"sequence(0, {last})", chunk)


def chunked_findings(text: str, size: int = READ_CHUNK, overlap: int = READ_OVERLAP) -> str:
    """Findings of a long text, chunk by chunk, in document offsets; a chunk gives those that start in what it owns.

    Everything happens inside the row.
    """
    def owned(c: str) -> str:
        return filter_(shift(scan_text(f"{c}.text"), f"{c}.start"),
                       lambda f: f"{f}.start >= {c}.own_from AND {f}.start < {c}.own_to")
    per_chunk = transform(owned_chunks(text, size, overlap), owned)
    return resolve_overlaps(sort_findings(f"flatten({per_chunk})", tuple(p.type for p in PATTERNS)))


# Where a chunk may end, best first, and how many characters of
# the mark go to the next chunk. A break counts only past the middle.
BREAKS = ((r"(?s).*\n\n", 0), (r"(?s).*(?:[.][ \n]|[?!] )", 1))


def boundary_chunks(df: DataFrame, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk (``chunk_start``, ``chunk``), cut at natural breaks."""
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be smaller than half the chunk")

    breaks = [(re.compile(regex), back) for regex, back in BREAKS]

    def length(window: str) -> int:
        for regex, back in breaks:
            last = regex.match(window)
            if last and last.end() - 2 > size // 2:
                return last.end() - back
        return size

    def chunks(text: str) -> Iterator[dict]:
        start = 0
        while len(text) - start > size:
            window = text[start:start + size]
            window = window[:length(window)]
            yield {"start": start, "text": window}
            start += len(window) - overlap
        if start < len(text):
            yield {"start": start, "text": text[start:]}

    @F.pandas_udf("array<struct<start:int,text:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: list(chunks(text or "")))

    return (df.withColumn("_chunk", F.explode(cut(F.col(text))))
            .withColumns({"chunk_start": F.col("_chunk.start"), "chunk": F.col("_chunk.text")})
            .drop("_chunk"))


def stride_chunks(df: DataFrame, text: str, size: int = READ_CHUNK, overlap: int = READ_OVERLAP) -> DataFrame:
    """One row per chunk (``chunk_start``, ``chunk``, ``own_from``, ``own_to``) of equal stride; no Python involved."""
    each = F.explode(F.expr(owned_chunks(name(text), size, overlap)))
    return (df.withColumn("_chunk", each)
            .withColumns({"chunk_start": F.col("_chunk.start"), "chunk": F.col("_chunk.text"),
                          "own_from": F.col("_chunk.own_from"), "own_to": F.col("_chunk.own_to")})
            .drop("_chunk"))


def scan_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Findings of chunk rows in document offsets, each from the chunk that owns its start; no shuffle."""
    found = chunks.select(key, "chunk_start", "own_from", "own_to", F.expr(scan_text("chunk")).alias("findings"))
    rows = explode_findings(found, key, "chunk_start", "own_from", "own_to")
    return (rows.withColumns({"start": F.col("start") + F.col("chunk_start"),
                              "end": F.col("end") + F.col("chunk_start")})
            .where("start >= own_from AND start < own_to").drop("chunk_start", "own_from", "own_to"))
