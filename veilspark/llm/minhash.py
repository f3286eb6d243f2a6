"""Near-duplicates by MinHash, confirmed on full shingle sets.

A document's set of word shingles gets 240 minima under universal hash functions. Six minima
are a band; two sets of similarity 0.85 share none of the 40 bands once in 170 million cases. Equal sets become one class first. Of each bucket, that is the classes of one
band key, the class that meets most others is the pivot, and every member is compared with it: a
group of copies gives a star, not all its pairs. Only in buckets whose classes are still in
several components after that are members of different components compared, tile by tile; a pair in
the first band it shares. Signatures and half-length hashes decide what is worth a look, the full sets
what is a link, and components are taken by alternating large-star and small-star steps. Pairs that are no links don't leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import lookup
from ..session import checkpoint
from .common import small, with_row_key
from .simhash import components

SHINGLE = 3
#: documents are linked from so many hundredths of their union in common
PERCENT = 85
BANDS, ROWS = 40, 6
MINIMA = BANDS * ROWS
#: standard deviations of the signature's estimate below the bound at which a pair is still looked at
MARGIN = 5
SEED = 42
#: shingles hashed by all functions at once
AT_ONCE = 128
#: members of a bucket that are compared at once, and bytes of their sets
TILE = 2048
TILE_BYTES = 4 << 20

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2)
PLACES = _random.integers(0, 1 << 63, max(ROWS, SHINGLE), np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = T.StructType([T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()),
                       T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set of k-word shingles as sorted 64-bit hashes; fewer words are one shingle, none are none.

    Words are runs of characters other than ASCII white space with A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + len(words))] if words else [], np.uint64)
    of_word = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    n = len(words) - k + 1
    return np.unique(mixed(reduce(np.add, (of_word[i: i + n] * PLACES[i] for i in range(k)))))


def minima(members: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set that isn't empty."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(members), AT_ONCE):
        hashed = members[at: at + AT_ONCE, None] * FACTORS
        hashed += OFFSETS
        np.minimum(least, hashed.min(axis=0), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key per band, different for different bands."""
    rows = (least.reshape(BANDS, ROWS) * PLACES[:ROWS]).sum(axis=1, dtype=np.uint64)
    return mixed(rows + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@F.pandas_udf(SIGNED)
def signed(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        members = shingles(text)
        if len(members):
            least = minima(members)
            rows.append((len(members), xxhash.xxh128_digest(members.astype("<u8").tobytes()), band_keys(least), least.astype(np.uint8).tobytes()))
        else:
            rows.append((0, None, None, None))
    return pd.DataFrame(rows, columns=["n", "cls", "bands", "signature"])


@F.pandas_udf(T.BinaryType())
def set_of(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).astype("<u8").tobytes() for t in texts], dtype=object)


def least_agreement(percent: int) -> int:
    """So many equal bytes of two signatures at least; minima that differ have equal bytes once in 256 times."""
    j = percent / 100
    bound = j - MARGIN * (j * (1 - j) / MINIMA) ** 0.5
    return int(MINIMA * (bound + (1 - bound) / 256))


@F.pandas_udf(T.IntegerType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    of = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(-1, MINIMA)
    return pd.Series((of(a) == of(b)).sum(axis=1, dtype=np.int32))


@F.pandas_udf(T.LongType())
def in_common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                      for x, y in zip(a, b, strict=True)], dtype="int64")


# -- candidates

def pivots(placed: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the member that meets most others in all its buckets."""
    met = placed.groupBy("node").agg(F.sum("count").alias("met"))
    first = (placed.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("most"))
             .select("key", F.col("most.node").alias("pivot")))
    return _pairs(placed.join(checkpoint(first), "key").where("node <> pivot"), "node", "pivot")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


@F.pandas_udf(T.BinaryType())
def shortened(members: pd.Series) -> pd.Series:
    """The upper halves of a set's hashes."""
    return pd.Series([(np.frombuffer(x, "<u8") >> np.uint64(32)).astype("<u4").tobytes() for x in members], dtype=object)


def _compare(percent: int):
    """(a, b): what may be a link between two tiles of a bucket, given by its key, whose members carry all that is compared.

    Members of one component are not compared, so a pair has two nodes.
    """
    least = least_agreement(percent)

    def read(tile: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        nodes, roots, bands, signatures, sets = tile.values.flatten()
        return (nodes.to_numpy(), roots.to_numpy(), bands.flatten().to_numpy().reshape(-1, BANDS),
                np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, MINIMA), [np.frombuffer(x, "<u4") for x in sets.to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, one, other in zip(batch.column("band").to_pylist(), batch.column("one"), batch.column("other"), strict=True):
                mine = read(one)
                nodes, roots, bands, left, sets = mine
                others, theirs, their_bands, right, their_sets = read(other) if other.is_valid else mine
                found = []
                for at in range(0, len(nodes), 16):
                    apart = roots[at: at + 16, None] != theirs[None, :]
                    if not apart.any():
                        continue
                    near = apart & ((left[at: at + 16, None, :] == right[None, :, :]).sum(axis=2) >= least)
                    for i, j in np.argwhere(near).tolist():
                        i += at
                        # a pair is the business of the first band it shares
                        if bands[i, np.argmax(bands[i] == their_bands[j])] == key:
                            x, y = sets[i], their_sets[j]
                            # sorted halves of hashes: no fewer in common than the whole ones have
                            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                            if 100 * common >= percent * (len(x) + len(y) - common):
                                found.append((nodes[i], others[j]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
    return run


def unsettled(placed: DataFrame, involved: DataFrame, roots: DataFrame, percent: int, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Pairs (a, b) of classes of different components that meet in a bucket and are links, if half of each hash can tell.

    A bucket of any size is cut into tiles of bounded size, and a task compares two of them; only such pairs leave it. Members
    go straight to the pairs of tiles they are in, so what they carry is shuffled once.
    """
    rooted = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sized = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(4 * F.sum("n") / tile_bytes)).cast("int")
    open_keys = checkpoint(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), sized.alias("cuts"))
                           .where("low <> high").select("key", "cuts"))
    inside = (rooted.join(small(open_keys), "key").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
              .select("key", F.least("cut", "with").alias("i"), F.greatest("cut", "with").alias("j"), "cut", "node", "root"))
    member = F.struct("node", "root", "bands", "signature", "members")
    low = lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int")  # noqa: E731  enough of a band's key to tell bands apart
    carried = involved.select("node", F.transform("bands", low).alias("bands"), "signature", shortened("members").alias("members"))
    tiles = (checkpoint(inside).join(carried, "node").groupBy("key", "i", "j")
             .agg(F.collect_list(F.when(F.col("cut") == F.col("i"), member)).alias("one"), F.collect_list(F.when(F.col("cut") == F.col("j"), member)).alias("other")))
    return checkpoint(tiles.select(low(F.col("key")).alias("band"), "one", F.when(F.col("i") != F.col("j"), F.col("other")).alias("other")).mapInArrow(_compare(percent), "a bigint, b bigint"))


def confirmed(pairs: DataFrame, involved: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sizes, signatures and, last, whole sets allow the link."""
    def end(which: str, *columns: str) -> DataFrame:
        return involved.select(F.col("node").alias(which), *(F.col(c).alias(f"{c}_{which}") for c in columns))
    likely = checkpoint(pairs.join(end("a", "n", "signature"), "a").join(end("b", "n", "signature"), "b")
                        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                        .where(agreement("signature_a", "signature_b") >= least_agreement(percent)).select("a", "b", "n_a", "n_b"))
    both = likely.join(end("a", "members"), "a").join(end("b", "members"), "b").withColumn("common", in_common("members_a", "members_b"))
    return checkpoint(both.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id and kept.

    Two documents are linked if ``percent`` hundredths of the union of their shingle sets are in both.
    component_id is the smallest key reachable by links, the row's own included; kept says that it is the row's own.
    NULL texts and texts without words have no shingles and no links. Rows of equal sets are linked, repeated rows
    come out as often as they occur, a NULL key counts only if its component has no other, and is kept then. Texts of any length are
    taken whole; other columns are not read; an empty table gives none.
    """
    keyed = with_row_key(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    rows = checkpoint(keyed.withColumn("s", signed("text")).select("doc_id", "_k1", "_k2", "s.*"))
    classes = checkpoint(rows.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("_k1", "_k2")).alias("of"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        .select("cls", "least", "n", "bands", "signature", "of.*").withColumn("node", F.monotonically_increasing_id()))
    in_band = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = checkpoint(in_band.groupBy("key").count().where("count > 1"))
    placed = checkpoint(in_band.join(small(shared), "key"))

    # only classes that meet another one need their sets
    nodes = checkpoint(placed.select("node").distinct())
    meeting = checkpoint(classes.join(small(nodes), "node").select("node", "n", "_k1", "_k2", "bands", "signature"))
    sets = (keyed.join(small(meeting.select("node", "_k1", "_k2")), ["_k1", "_k2"]).dropDuplicates(["node"])
            .select("node", set_of("text").alias("members")))
    involved = checkpoint(meeting.select("node", "n", "bands", "signature").join(sets, "node"))
    links = confirmed(pivots(placed), involved, percent)
    links = links.unionByName(confirmed(unsettled(placed, involved, components(links), percent), involved, percent))
    rooted = classes.select("cls", "node", "least").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("cls", "component_id")
    found = lookup(rows.select("doc_id", "_k2", "n", "cls"), named, "cls", spread_by=["doc_id", "_k2"], materialize=True)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))
