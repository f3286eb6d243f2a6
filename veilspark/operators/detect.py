"""Detection over DataFrames. All of it is narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import find_pii, parse_model_findings, scan_text, union_detectors
from ..functions.spans import mark_kept
from ..functions.sql import name, transform
from ..patterns import PATTERNS, Pattern


def raw_findings(df: DataFrame, text: str, out: str = "findings",
                 patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Add every match of every pattern."""
    return df.withColumn(out, F.expr(find_pii(name(text), patterns)))


def marked_findings(df: DataFrame, text: str, out: str = "findings",
                    patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Add every match with a flag telling whether overlap resolution keeps it."""
    return df.withColumn(out, F.expr(mark_kept(find_pii(name(text), patterns))))


def scan(df: DataFrame, text: str, out: str = "findings",
         patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Add the resolved findings of a text column."""
    return df.withColumn(out, F.expr(scan_text(name(text), patterns)))


def explode_findings(df: DataFrame, *keys: str, findings: str = "findings") -> DataFrame:
    """One row per finding, with the given key columns.

    The array goes through an identity transform: exploding a plain column lets
    the optimizer derive filters on it, which would run the detectors again.
    """
    each = F.explode(F.expr(transform(name(findings), lambda f: f)))
    return df.select(*keys, each.alias("f")).select(*keys, "f.*")


def model_replies(df: DataFrame, text: str, model: Callable[[str], str], out: str = "reply") -> DataFrame:
    """Call a contextual detector of yours on every row's text.

    ``model`` maps text to its JSON reply. A text it fails on gets no findings;
    a lost connection ends the job, since every further call would fail too.
    """
    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            if t is None:
                return None
            try:
                return model(t)
            except ConnectionError:
                raise
            except Exception:
                return None
        for batch in batches:
            yield batch.map(one)

    return df.withColumn(out, ask(F.col(text)))


def scan_with_model(df: DataFrame, text: str, reply: str, out: str = "findings",
                    patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Patterns and a model's reply together; the model wins at equal starts."""
    return df.withColumn(out, F.expr(union_detectors(
        find_pii(name(text), patterns), parse_model_findings(name(reply)))))
