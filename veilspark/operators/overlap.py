"""Which findings collide, and which of them overlap resolution drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import dropped_only, kept_only, overlaps_loosely
from ..functions.sql import filter_, let, name, running, struct, transform
from .detect import explode_findings

# a span that sorts by start, then longest, then type
SPAN = "struct<start:int,size:int,type:string>"


def kept_findings(marked: DataFrame, *keys: str, findings: str = "findings") -> DataFrame:
    """One row per finding that stands."""
    return explode_findings(marked.select(*keys, F.expr(kept_only(name(findings))).alias("k")), *keys, findings="k")


def dropped_findings(marked: DataFrame, *keys: str, findings: str = "findings") -> DataFrame:
    """One row per finding that gave way to an earlier one. No join needed: the flag is there."""
    return explode_findings(marked.select(*keys, F.expr(dropped_only(name(findings))).alias("d")), *keys, findings="d")


def overlap_pairs(found: DataFrame, key: str, findings: str = "findings") -> DataFrame:
    """Pairs of findings of one document that collide, earlier one first.

    ``found`` has one document per row, with its findings in an array. A sweep goes through them by start and keeps
    the spans that are still open; each finding is held against these only. Nothing is joined or shuffled, and a
    document may have any number of findings.
    """
    spans = transform(name(findings), lambda f: "CAST(" + struct(start=f"{f}.start", size=f"-{f}.`end`", type=f"{f}.type") + f" AS {SPAN})")

    def step(still_open: str, f: str) -> tuple[str, str]:
        ahead = filter_(still_open, lambda s: f"-{s}.size - 2 > {f}.start")
        met = let(ahead, lambda spans: f"concat({spans}, array({f}))")
        # whatever has not ended two characters before this one starts is open, so the last test is all that's left
        return met, transform(filter_(still_open, lambda s: overlaps_loosely(f"{s}.start", f"-{s}.size", f"{f}.start", f"-{f}.size")),
                              lambda s: struct(a=s, b=f))
    pairs = running(f"array_sort({spans})", f"CAST(array() AS array<{SPAN}>)", step, f"array<struct<a:{SPAN},b:{SPAN}>>", f"array<{SPAN}>")
    end = lambda t: F.negative(f"p.{t}.size").alias(f"end_{t}")
    return (found.select(F.col(name(key)), F.explode(F.expr(f"flatten({pairs})")).alias("p"))
            .select(F.col(name(key)), F.col("p.a.type").alias("type_a"), F.col("p.a.start").alias("start_a"), end("a"),
                    F.col("p.b.type").alias("type_b"), F.col("p.b.start").alias("start_b"), end("b")))
