"""Quality rules and a hashed n-gram likelihood ratio of target and raw corpus.

Words and word pairs are hashed into buckets. Over all documents, and over those of
a trusted target, buckets are counted. A document scores the mean, over its n-grams,
of ln(p_target / p_raw); it is kept if it passes the base rules and scores no less
than a fixed threshold. Nothing is drawn at random.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .common import clear_of, small

BUCKETS = 1 << 14
#: counts added to every bucket, as a multiple of the mean count, in the target and in the raw corpus alike
SMOOTHING = 1.0
#: mean log ratio below which a document is rejected
THRESHOLD = -0.045
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS.encode()) + b"]")


def buckets_of(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and all pairs of neighbours."""
    crc = zlib.crc32
    one = np.fromiter(map(crc, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:]
    two ^= two >> np.uint64(29)
    return np.concatenate((one, two * np.uint64(0x85EBCA6B) >> np.uint64(16))) % np.uint64(buckets)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    names, width = ids, 1
    while width < window:  # equal names stand for equal runs of words
        step = min(width, window - width)
        pairs = names[: len(names) - step] * np.int64(len(words) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width += step
    twice = np.bincount(names)[names] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _counts(buckets: int):
    """Per task the counts of the buckets; the target is where ``trusted`` is true."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, trusted in zip(batch["text"], batch["trusted"], strict=True):
                found = np.bincount(buckets_of(_bytes(text).split(), buckets).astype(np.int64), minlength=buckets)
                raw += found
                if trusted:
                    target += found
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})
    return run


def log_ratios(docs: DataFrame, trusted: Column, text: str = "text", buckets: int = BUCKETS,
               smoothing: float = SMOOTHING) -> np.ndarray:
    """ln(p_target / p_raw) by bucket, from all documents; the result has ``buckets`` numbers however many they are.

    Both are smoothed by the same share of their own mean count, so that an n-gram that neither
    has seen says nothing; without any target all ratios are zero.
    """
    counted = (docs.select(F.col(text).alias("text"), F.coalesce(trusted, F.lit(False)).alias("trusted"))
               .mapInPandas(_counts(buckets), "bucket bigint, raw bigint, target bigint")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counted["bucket"]], target[counted["bucket"]] = counted["raw"], counted["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target * buckets / target.sum() + smoothing) / (raw * buckets / raw.sum() + smoothing))


MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                        + [T.StructField("llr", T.DoubleType())])


def measure(text: str | None, ratios: np.ndarray) -> tuple:
    raw = _bytes(text)
    words = raw.split()
    llr = float(ratios[buckets_of(words, len(ratios)).astype(np.int64)].mean()) if words else 0.0
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    return len(words), chars, len(_SYMBOL.findall(raw)), duplicate_lines(raw), repeated_words(words), llr


def judge(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept.

    ``trusted_ids`` has the key column of the documents of the target; ids in it that docs
    lack, NULLs and repeats do nothing. A NULL text has no words, so it fails the base
    rules, as an empty one does. Long texts are read whole, repeated rows judged alike and
    all counted; columns with the names of the results are replaced. No row is dropped.
    """
    names = MEASURES.names + ["base_failed", "kept"]
    docs = clear_of(docs, *names)
    ids = checkpoint(trusted_ids.select(F.col(key).alias("_trusted")).where("_trusted is not null").distinct())
    marked = (docs.select(key, text).join(small(ids), F.col(key) == F.col("_trusted"), "left"))
    ratios = docs.sparkSession.sparkContext.broadcast(
        log_ratios(marked, F.col("_trusted").isNotNull(), text, buckets, smoothing))  # a fixed number of buckets

    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        table = ratios.value
        return pd.DataFrame([measure(t, table) for t in texts], columns=MEASURES.names)

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (docs.withColumn("_measured", measured(F.col(text))).select(*docs.columns, "_measured.*")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.round("llr", 9) >= threshold)))
