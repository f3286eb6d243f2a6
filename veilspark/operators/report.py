"""Counts and reports over scanned documents.

Per-document figures come from the document's own findings array and need no
shuffle; only totals across documents do, and those aggregate map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import filter_, name, struct, transform
from .detect import explode_findings


def counts_of(findings: str, field: str) -> str:
    """``map<value, count>`` over a field of a findings array, keys in order."""
    values = f"array_sort(array_distinct({transform(findings, lambda f: f'{f}.{field}')}))"
    n = lambda v: f"size({filter_(findings, lambda f: f'{f}.{field} = {v}')})"
    return f"map_from_entries({transform(values, lambda v: struct(k=v, n=n(v)))})"


def top_categories(findings: str, k: int = 3) -> str:
    """The k most frequent categories as ``CAT (n), ...``; ties by name; ``clean`` if none."""
    values = f"array_distinct({transform(findings, lambda f: f'{f}.category')})"
    n = lambda v: f"-size({filter_(findings, lambda f: f'{f}.category = {v}')})"
    ranked = f"slice(array_sort({transform(values, lambda v: struct(n=n(v), c=v))}), 1, {k})"
    text = transform(ranked, lambda r: f"concat({r}.c, ' (', -{r}.n, ')')")
    return f"IF(size({findings}) = 0, 'clean', array_join({text}, ', '))"


def document_stats(df: DataFrame, *keys: str, text: str = "text", findings: str = "findings") -> DataFrame:
    """Per document: findings, counts by category and method, scanned characters."""
    f = name(findings)
    return df.select(
        *keys, F.expr(f"size({f})").alias("total"),
        F.expr(counts_of(f, "category")).alias("by_category"),
        F.expr(counts_of(f, "method")).alias("by_method"),
        F.coalesce(F.length(text), F.lit(0)).alias("scanned_chars"))


def document_report(df: DataFrame, *keys: str, findings: str = "findings") -> DataFrame:
    """Per document: number of findings and its top three categories.

    Documents without findings stay in, marked clean.
    """
    f = name(findings)
    return df.select(*keys, F.expr(f"size({f})").alias("total"),
                     F.expr(top_categories(f)).alias("categories"))


def totals(df: DataFrame, *by: str, findings: str = "findings") -> DataFrame:
    """Findings over all documents, counted by finding fields such as category or type."""
    return explode_findings(df, findings=findings).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rollup(df: DataFrame, source: str, findings: str = "findings") -> DataFrame:
    """Findings by source and category, with subtotals per source and a grand total.

    Only categories leave a row's findings; they are counted first, and the subtotals come from the counts.
    """
    each = F.explode(F.expr(transform(name(findings), lambda f: f"{f}.category"))).alias("category")
    counts = df.select(source, each).groupBy(source, "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.rollup(source, "category").agg(F.sum("n").alias("n"))


def scan_totals(df: DataFrame, text: str = "text", findings: str = "findings") -> DataFrame:
    """One row: documents, documents with findings, findings and characters."""
    n = F.size(findings)
    return df.agg(F.count(F.lit(1)).alias("documents"),
                  F.count_if(n > 0).alias("with_findings"),
                  F.coalesce(F.sum(n), F.lit(0)).alias("findings"),
                  F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("scanned_chars"))


def sample_findings(df: DataFrame, *keys: str, findings: str = "findings", k: int = 5,
                    width: int = 60) -> DataFrame:
    """The first k findings of every document as short one-line snippets.

    ``more`` tells how many further findings the document has.
    """
    f = name(findings)
    picked = df.select(*keys, F.expr(f"greatest(size({f}) - {k}, 0)").alias("more"),
                       F.posexplode(F.expr(f"slice({f}, 1, {k})")).alias("pos", "f"))
    return picked.select(
        *keys, (F.col("pos") + 1).alias("rank"), F.col("f.category").alias("category"),
        F.replace(F.left("f.match", F.lit(width)), F.lit("\n"), F.lit("\\n")).alias("snippet"),
        F.coalesce("f.confidence", F.lit(1.0)).alias("confidence"), "more")


def first_sample(df: DataFrame, key: str, findings: str = "findings", k: int = 5) -> DataFrame:
    """The sample of the first document, by key, that has findings."""
    first = df.filter(F.size(findings) > 0).select(key, findings).orderBy(key).limit(1)
    return sample_findings(first, key, findings=findings, k=k)


def with_findings(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Only documents in which something was found."""
    return df.filter(F.size(findings) > 0)


def value_free(findings: str) -> str:
    """Findings as an audit may show them: without the matched text."""
    return transform(findings, lambda f: struct(
        category=f"{f}.category", type=f"{f}.type", start=f"{f}.start", end=f"{f}.`end`",
        method=f"{f}.method", confidence=f"coalesce({f}.confidence, 1.0D)"))


def method_label(by_method: str) -> str:
    """Names of the detectors that found something, in order, joined by ``+``."""
    return f"array_join(array_sort(map_keys({by_method})), '+')"
