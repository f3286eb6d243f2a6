"""Near-duplicates by SimHash: exact tiled comparison of all fingerprints.

A fingerprint has 64 bits. Distinct fingerprints are sorted into tiles by the
population counts of their parts (four of 16 bits at first). Two fingerprints
within the radius differ in these counts by no more than the radius in total,
so tile pairs further apart are skipped and every link is still found. Inside a
pair of tiles numpy compares all against all with exclusive-or and bit counts;
of the links only a spanning forest leaves the task, so a group of copies never
turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .common import give_back, packed, with_row_key

SHINGLE = 3
SEED = 42
RADIUS = 2
#: fingerprints of one tile that are compared at once
TILE_ROWS = 4096
#: hashes whose bits are spread out at once
BITS_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as a signed 64-bit integer; 0 for a text without words.

    Words are runs of characters other than ASCII white space with A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1:].tolist(), strict=True)),
                         np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        some = hashes[at: at + BITS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")
    give_back()


def parts_for(fingerprints: int) -> int:
    """Into how many parts, two or more, a fingerprint is cut for its tile; the links are the same for any number.

    More parts skip more of the comparisons and copy each tile to more neighbours.
    """
    return 4 if fingerprints <= 1 << 24 else 8 if fingerprints <= 1 << 31 else 16


def _steps(parts: int, radius: int) -> list[list[int]]:
    """Count differences of tiles to compare: each unordered pair of tiles once."""
    found = [[0] * parts]
    for _ in range(radius):
        found += [s[:i] + [s[i] + d] + s[i + 1:] for s in found for i, d in product(range(parts), (-1, 1))]
    return [list(s) for s in sorted(set(map(tuple, found))) if s >= (0,) * parts]


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Of the links among n things a spanning forest."""
    above = list(range(n))
    for a, b in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = a, b
        while above[a] != a:
            above[a] = a = above[above[a]]
        while above[b] != b:
            above[b] = b = above[above[b]]
        if a != b:
            above[max(a, b)] = min(a, b)
            yield x, y


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right, same in zip(batch["a"], batch["b"], batch["same"], strict=True):
                # unsigned: numpy counts the bits of a negative number's absolute value
                x, y = np.asarray(left, np.int64).view(np.uint64), np.asarray(right, np.int64).view(np.uint64)
                rows, cols = [], []
                for at in range(0, len(x), 256):
                    near = np.bitwise_count(x[at: at + 256, None] ^ y[None, :]) <= radius
                    i, j = np.nonzero(near)
                    rows.append(i + at)
                    cols.append(j)
                i, j = np.concatenate(rows), np.concatenate(cols)
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i) == 0:
                    continue
                both = x if same else np.concatenate((x, y))
                kept = list(_forest(i, j if same else j + len(x), len(both)))
                a, b = np.array(kept).T
                yield pd.DataFrame({"a": both[a].view(np.int64), "b": both[b].view(np.int64)})
    return run


def links(prints: DataFrame, radius: int = RADIUS, parts: int | None = None,
          tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all within the radius."""
    parts = parts or parts_for(prints.count())
    width = 64 // parts
    counts = F.array(*(F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1))
                       .cast("int") for i in range(parts)))
    tiled = prints.select("fp", counts.alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("cuts"))
    cut = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut")
    tiles = checkpoint(tiled.join(sizes, "tile").groupBy("tile", cut).agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    steps = F.array(*(F.array(*map(F.lit, s)) for s in _steps(parts, radius)))
    here = (tiles.select("tile", F.col("cut").alias("cut_a"), F.col("fps").alias("a"), F.explode(steps).alias("step"))
            .select(F.col("tile").alias("from"), F.zip_with("tile", "step", lambda t, s: t + s).alias("tile"), "cut_a", "a"))
    there = tiles.select("tile", F.col("cut").alias("cut_b"), F.col("fps").alias("b"))
    same_tile = F.col("from") == F.col("tile")
    pairs = (here.join(there, "tile").where(~same_tile | (F.col("cut_a") <= F.col("cut_b")))
             .select("a", "b", (same_tile & (F.col("cut_a") == F.col("cut_b"))).alias("same")))
    return pairs.mapInPandas(_compare(radius), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps by turns until nothing changes. Both use a
    minimum per node, which Spark combines before the shuffle, and a join back,
    so a node with very many neighbours never gathers them in one place.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct())
        following = checkpoint(small)
        n, was = following.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first(), edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        edges = following
        if n == was:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits) and component_id.

    component_id is the smallest key among all rows whose fingerprints are linked,
    directly or in steps, by at most ``radius`` differing bits. NULL and empty texts
    have fingerprint zero and link like any other; repeated rows each get a row; a
    NULL key counts only if its component has no other. An empty table gives none.
    """
    rows = checkpoint(docs.select(F.col(key).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")))
    prints = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints, radius)).select(F.col("node").alias("fp"), "root")
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Documents without their near copies, with the columns they had: of each group the row of the smallest
    id stays, of several such rows one of the largest text hash; rows without an id yield to those with one."""
    keyed = with_row_key(packed(docs, "doc_id", "text"))
    fps = checkpoint(keyed.select("doc_id", "_k1", "_k2", fingerprint_of(F.col("text")).alias("fp")))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("_k1"), (-F.col("_k2").cast("decimal(20,0)")).alias("h"), F.col("_k2"))
    prints = checkpoint(fps.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(prints, radius)).select(F.col("node").alias("fp"), "root")
    firsts = (prints.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
              .agg(F.min("first").alias("first")).select("first._k1", "first._k2"))
    return keyed.join(firsts, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("_row.*")
