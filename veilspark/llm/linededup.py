"""Removal of repeated chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of lines decides behind which lines a chunk ends, so where chunks begin and
end depends on the lines themselves and not on what stands before a passage. The window is one line, so that
a passage of a few lines is cut alike wherever it stands; a line of more than 50 words is always a
chunk of its own. A chunk counts with two lines that have words and ten words in all, or with more
than 50 words. Chunks never overlap: of those that are equal, byte for byte, the first by document and place
stays, whole, and the others go. So whatever is removed still stands, in one piece, in another place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import clear_of, small, with_row_key

#: lines the rolling hash looks at, and the mean number of lines of a chunk
WINDOW = 1
DIVISOR = 3
FACTOR = 31
#: a chunk counts with so many lines that have a word, and so many words
LEAST_LINES = 2
LEAST_WORDS = 10
#: a line of more words is a chunk that counts
LONG_LINE = 50

WORD = r"[^\x20\x09-\x0D]++"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Work a value out once for an expression that uses it many times."""
    return F.element_at(F.transform(F.array(value), then), 1)


def digest(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def body(lines: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def chunks_of(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Chunks of a text in order: (start, n, lines with words, words). NULL for NULL."""
    def measure(line: Column) -> Column:
        return F.struct(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint").alias("h"), F.regexp_count(line, F.lit(WORD)).alias("w"))

    def ends(m: Column) -> Column:
        last = F.size(m) - 1
        rolled = lambda i: sum((F.coalesce(F.get(m, i - k)["h"], F.lit(0)) * FACTOR ** k for k in range(1, window)), F.get(m, i)["h"])
        long = lambda i: F.coalesce(F.get(m, i)["w"] > LONG_LINE, F.lit(False))
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | long(i) | long(i + 1) | (rolled(i) % divisor == 0))

    def cut(m: Column) -> Column:
        def chunk(start: Column, end: Column) -> Column:
            return let(F.slice(m, start + 1, end - start + 1), lambda part: F.struct(
                start.alias("start"), (end - start + 1).alias("n"), F.size(F.filter(part, lambda x: x["w"] > 0)).alias("worded"),
                F.aggregate(part, F.lit(0), lambda n, x: n + x["w"]).alias("words")))
        return let(ends(m), lambda at: F.transform(at, lambda e, i: let(F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1) + 1), lambda s: chunk(s, e))))
    return F.when(text.isNotNull(), let(F.transform(lines_of(text), measure), cut))


def counts(chunk: Column) -> Column:
    """Whether a chunk is large enough to be removed where it repeats."""
    return (chunk["worded"] >= LEAST_LINES) & (chunk["words"] >= LEAST_WORDS) | (chunk["words"] > LONG_LINE)


def repeated(docs: DataFrame, text: str) -> DataFrame:
    """(_k1, _k2, start, n): chunks that equal one at an earlier place. docs have the row key.

    Numbers find the candidates; then the bytes of each candidate are held against those of the others.
    """
    held = docs.where(F.col(text).isNotNull()).select("_k1", "_k2", F.col(text).alias("text"))
    large = F.filter(chunks_of(F.col("text")), counts)
    # one narrow row per chunk, written once; equal rows of docs are one document
    spans = checkpoint(held.select("_k1", "_k2", F.explode(let(lines_of(F.col("text")), lambda l: F.transform(large, lambda c: F.struct(
        c["start"].alias("start"), c["n"].alias("n"), digest(body(l, c["start"], c["n"])).alias("h"))))).alias("c"))
        .select("_k1", "_k2", "c.*").distinct())
    place = F.struct("_k1", "_k2", "start")
    again = checkpoint(spans.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1").select("h", "first"))
    candidates = checkpoint(spans.join(small(again), "h"))
    at = checkpoint(candidates.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "n", "h")).alias("_at")))  # of one document
    bodies = (held.join(small(at), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
              .select("_k1", "_k2", F.explode(let(lines_of(F.col("text")), lambda l: F.transform("_at", lambda c: F.struct(
                  c["start"].alias("start"), c["h"].alias("h"), body(l, c["start"], c["n"]).alias("body"))))).alias("c"))
              .select("_k1", "_k2", "c.*"))
    # if the least and the greatest text of a number are the same bytes, all are
    mixed = checkpoint(bodies.groupBy("h").agg((F.min("body") != F.max("body")).alias("mixed")).where("mixed").select("h"))
    if mixed.isEmpty():
        found = candidates
    else:
        apart = bodies.join(small(mixed), "h")
        firsts = apart.groupBy("h", "body").agg(F.min(place).alias("first"))
        told = apart.join(firsts, ["h", "body"]).select("_k1", "_k2", "start", "h", "first")
        found = candidates.join(small(mixed), "h", "left_anti").unionByName(
            candidates.drop("first").join(told, ["_k1", "_k2", "start", "h"]).select(*candidates.columns))
    return found.where(place != F.col("first")).select("_k1", "_k2", "start", "n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``text`` freed of repeated chunks, n_lines (before) and n_removed.

    The first occurrence of a chunk, by id (NULL before all), text hash and place, stays as it is. NULL texts stay NULL with no lines, empty
    texts have one line; a document of nothing but repeated chunks becomes empty. Rows equal in id and text are one document and
    come out alike. Columns with the names of the results are replaced; an empty table gives
    none. Lines and chunks may be of any length.
    """
    docs = clear_of(docs, "n_lines", "n_removed", "_k1", "_k2")
    keyed = with_row_key(docs, key, text)
    gone = F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)
    removed = checkpoint(repeated(keyed, text).groupBy("_k1", "_k2").agg(F.flatten(F.collect_list(gone)).alias("_gone")))  # of one document
    out = keyed.join(small(removed), ["_k1", "_k2"], "left")
    stay = lambda l: F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("_gone"))
    kept = let(lines_of(F.col(text)), lambda l: F.array_join(F.transform(stay(l), lambda i: F.get(l, i)), "\n"))
    done = out.withColumn("_kept", F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept))
    return done.select(*(F.col("_kept").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns),
                       F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_of(F.col(text)))).cast("bigint").alias("n_lines"),
                       F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"))
