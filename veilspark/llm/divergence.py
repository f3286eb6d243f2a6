"""How far the sources of a language differ in their words, exactly, over run-length columns.

Tasks count terms in bounded tables, so what is shuffled is a number for each group, term and flush.
The vocabulary of a language is then put in order of its counts: by the count in the largest source,
among equals by that in the next one, and so on. In this order a source's counts are a column of few,
long runs. Tasks get consecutive stretches of the order, run-length encode every source's
column, lay the runs of two sources over each other, and multiply the value of each common
run by its length. All arithmetic is with whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import small

#: a language keeps terms in so many of its documents
LEAST_DOCUMENTS = 10
#: terms listed per group
TOP = 10
UNIT = 1_000_000_000
SMOOTHING = 2
#: different terms a task holds before it gives its counts away
HELD = 200_000
#: counts (terms x sources) of a stretch that is compared at once
STRETCH = 1 << 20

# Fixed value: letters of terms are a-z, A-Z lower-cased, and all beyond ASCII; other bytes part them.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

FOUND = "l int, r int, other int, term string, value bigint"


# -- counting

def _counts(group_of: dict[tuple[str, str], tuple[int, int]]):
    """(l, r, term, n, df) of a task's documents: occurrences and documents, given away when there are many."""
    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, rank), (n, df) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.int32()), pa.array([rank] * len(terms), pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(n.values(), pa.int64()), pa.array([df[t] for t in terms], pa.int64())], ["l", "r", "term", "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().translate(LETTERS).split()
                if not words:
                    continue
                n, df = held[group_of[lang, source]]
                size -= len(n)
                n.update(words)
                df.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from flush(held)
                    held.clear()
                    size = 0
        yield from flush(held)
    return run


# -- run-length columns

def run_lengths(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal counts begin, and their counts."""
    starts = np.flatnonzero(np.diff(column, prepend=column[:1] - 1))
    return starts, column[starts]


def share(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of counts: 1 + floor(UNIT * (count + 2) / (N + 2 V))."""
    wide = counts if int(counts.max(initial=0)) < (1 << 63) // UNIT - SMOOTHING else counts.astype(object)
    return 1 + UNIT * (wide + SMOOTHING) // (total + SMOOTHING * terms)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of two shares: floor((p - q)^2 / (p + q))."""
    return (p - q) * (p - q) // (p + q)


def common_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of both columns on the runs they have in common, and the lengths of these."""
    starts = np.union1d(a[0], b[0])
    at = lambda runs: runs[1][np.searchsorted(runs[0], starts, side="right") - 1]
    return at(a), at(b), np.diff(starts, append=size)


def _compare(totals: list[list[int]], kept: list[int], top: int):
    """Sums of f for pairs r < other of a task's stretches, and its best terms of each group."""
    def stretch(lang: int, terms: list[str], ends: np.ndarray, ranks: np.ndarray, n: np.ndarray, sums: dict, best: dict) -> None:
        size, sources, v = len(terms), len(totals[lang]), kept[lang]
        starts = np.concatenate(([0], ends[:-1]))
        rows = np.repeat(np.arange(size), ends - starts)
        whole = share(np.add.reduceat(n, starts), sum(totals[lang]), v)
        by_rank = np.argsort(ranks, kind="stable")
        cuts = np.searchsorted(ranks[by_rank], np.arange(sources + 1))
        columns = []
        for r in range(sources):
            mine = by_rank[cuts[r]: cuts[r + 1]]
            column = np.zeros(size, np.int64)
            column[rows[mine]] = n[mine]
            at, counts = run_lengths(column)
            columns.append((at, share(counts, totals[lang][r], v)))
            p, q = share(n[mine], totals[lang][r], v), whole[rows[mine]]
            more = np.flatnonzero(p > q)
            f = difference(p[more], q[more])
            if len(f) > top:  # all that equal the last one stay until terms decide
                enough = f >= np.partition(f, len(f) - top)[len(f) - top]
                more, f = more[enough], f[enough]
            if len(f):
                found = [(-int(x), terms[rows[mine[m]]].encode()) for x, m in zip(f, more.tolist(), strict=True)]
                best[lang, r] = sorted(best.get((lang, r), []) + found)[:top]
        for a in range(sources):
            for b in range(a + 1, sources):
                p, q, lengths = common_runs(columns[a], columns[b], size)
                sums[lang, a, b] = sums.get((lang, a, b), 0) + int((difference(p, q) * lengths).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], int] = {}
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            langs = batch.column("l").to_numpy()
            for lang in np.unique(langs).tolist():
                at = np.flatnonzero(langs == lang)
                width = max(1, STRETCH // len(totals[lang]))
                for some in np.split(at, range(width, len(at), width)):
                    part = batch.take(pa.array(some))
                    entries, ends = part.column("counts").flatten(), np.cumsum(np.diff(part.column("counts").offsets.to_numpy()))
                    stretch(lang, part.column("term").to_pylist(), ends, entries.field("r").to_numpy(), entries.field("n").to_numpy(), sums, best)
        found = [(*k, None, v) for k, v in sums.items()] + [(l, r, None, t.decode(), -f) for (l, r), b in best.items() for f, t in b]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (
                pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["l", "r", "other", "term", "value"])
    return run


# -- the audit

def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its own terms.

    Part ``pair`` has a row for each other source of the language, of all ranks; part ``term`` the ``top`` terms that
    are more frequent in the source than in its language. NULL texts, languages and sources are empty strings;
    a text may be of any length; repeated rows count as often as they occur; ties go by the bytes of the item; other
    columns, whatever their names, are not read; an empty table gives no rows. Groups without any
    term take part, with a count of zero; a language that keeps no term has differences of 0. The driver has one
    row for each group; the result has its square.
    """
    spark = docs.sparkSession
    filled = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = filled.groupBy("lang", "source").count().orderBy("lang", F.desc("count"), "source").collect()
    langs = {lang: i for i, lang in enumerate(dict.fromkeys(g["lang"] for g in groups))}
    sizes = [0] * len(langs)
    group_of: dict[tuple[str, str], tuple[int, int]] = {}
    for g in groups:
        lang = langs[g["lang"]]
        group_of[g["lang"], g["source"]] = lang, sizes[lang]
        sizes[lang] += 1
    names = spark.createDataFrame([(*at, *name) for name, at in group_of.items()], "l int, r int, lang string, source string")

    counted = (filled.select("lang", "source", F.col("text").cast("binary").alias("text"))
               .mapInArrow(_counts(group_of), "l int, r int, term string, n bigint, df bigint")
               .groupBy("l", "r", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    kept = checkpoint(counted.groupBy("l", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("r", "n")).alias("counts"))
                      .where(F.col("df") >= least).select("l", "term", F.array_sort("counts").alias("counts")))
    totals, terms = [[0] * s for s in sizes], [0] * len(langs)
    for t in kept.select("l", F.explode("counts").alias("c")).groupBy("l", "c.r").agg(F.sum("c.n").alias("n")).collect():
        totals[t["l"]][t["r"]] = t["n"]
    for t in kept.groupBy("l").count().collect():
        terms[t["l"]] = t["count"]

    order = ["l", "counts", "term"]
    found = checkpoint(kept.repartitionByRange("l", F.slice("counts", 1, 3), "term").sortWithinPartitions(*order).select(*order).mapInArrow(_compare(totals, terms, top), FOUND))
    one_way = found.where("other is not null").groupBy("l", "r", "other").agg(F.sum("value").alias("value"))
    both = one_way.unionByName(one_way.select("l", F.col("other").alias("r"), F.col("r").alias("other"), "value"))
    others = names.select("l", F.col("r").alias("other"), F.col("source").alias("item"))
    pairs = (names.join(small(others), "l").where("r <> other").join(both, ["l", "r", "other"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value")))
    own = (found.where("term is not null").join(small(names), ["l", "r"])
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(own).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
