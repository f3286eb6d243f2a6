"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

Texts are tokenised once into a table. Ids are counted over all of it, and a
canonical code of at most 16 bits is made of the counts. Documents, in ascending
order of id, are packed into blocks of whole documents; a block holds its bits and,
every so many ids, the bit offset, from which decoding can start. Decoding looks
up 16 bits at a time in a table, for all offsets of a batch of blocks at once.

The file format is a folder of two Parquet tables: ``code`` (id, length), and
``blocks`` (file, block, start, doc_ids, doc_lens, n_ids, every, offsets, bits), whose files
are in order of id; ``start`` counts the ids before the block in its file.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .bytelevel import encoder_of, tokenizer_of
from .common import give_back

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
LONGEST = 16
#: a block is closed once it has so many ids
BLOCK_IDS = 1 << 16
#: ids between two bit offsets
EVERY = 512
#: documents handled at once
AT_ONCE = 256
#: blocks decoded side by side
BLOCKS_AT_ONCE = 16

BLOCKS = T.StructType([
    T.StructField("file", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_lens", T.ArrayType(T.LongType())),
    T.StructField("n_ids", T.LongType()), T.StructField("every", T.IntegerType()),
    T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])
BLOCKS_ARROW = pa.schema({"file": pa.int32(), "block": pa.int64(), "start": pa.int64(), "doc_ids": pa.list_(pa.int64()),
                          "doc_lens": pa.list_(pa.int64()), "n_ids": pa.int64(), "every": pa.int32(),
                          "offsets": pa.list_(pa.int64()), "bits": pa.binary()})


# -- tokenising

def id_type(path: str) -> str:
    """Ids of a vocabulary of up to 65536 are kept in two bytes, of larger ones in four."""
    return "<u2" if tokenizer_of(path).get_vocab_size() <= 1 << 16 else "<u4"


def _tokenise(path: str, end_id: int, kind: str, forget: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder_of(path, kind), np.array([end_id], kind).tobytes()
        try:
            for batch in batches:
                for at in range(0, len(batch), AT_ONCE):
                    some = batch.slice(at, AT_ONCE)
                    ids = pa.array([encode(t or "") + end for t in some["text"].to_pylist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([some["doc"], ids], ["doc", "ids"])
        finally:
            if forget:
                encode.forget()
            give_back()
    return run


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
              end_id: int = END_ID, forget: bool = False) -> DataFrame:
    """(doc_id, ids): ids with the end id, of ``id_type``; NULL is an empty text.

    Processes remember pieces from one task to the next, unless they are to ``forget`` them.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    # an id may be NULL, so it goes through Python as text
    return (docs.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text"))
            .mapInArrow(_tokenise(path, end_id, id_type(path), forget), "doc string, ids binary")
            .select(F.col("doc").cast("bigint").alias("doc_id"), "ids"))


# -- the code

def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of a best prefix code of at most ``longest`` bits, by merging packages; 0 for a count of zero."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # per level: the sorted list's weights, and which entries are symbols
    level, levels = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((weights, pairs))
        sort = np.argsort(merged, kind="stable")
        level = merged[sort]
        levels.append(sort < n)
    take = 2 * n - 2
    for symbols in reversed(levels):
        single = int(symbols[:take].sum())
        lengths[order[:single]] += 1
        take = 2 * (take - single)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of id."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code = before = 0
    for i in order[np.count_nonzero(lengths == 0):].tolist():
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Id and length of the code at the head of every possible string of ``longest`` bits."""
    ids, sizes = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    codes = canonical(lengths)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    spans = (1 << (longest - lengths[order])).astype(np.int64)
    firsts = codes[order] << (longest - lengths[order])
    if len(order):
        end = int(firsts[-1] + spans[-1])
        ids[:end], sizes[:end] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


# -- bits

def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """The bits of ids, most significant first, and the bit offset of every ``every``-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    sizes, code = lengths[ids].astype(np.uint8, copy=False), codes[ids]
    sums = np.cumsum(np.add.reduceat(sizes, np.arange(0, len(ids), every), dtype=np.int64))
    total, offsets = int(sums[-1]), np.concatenate(([0], sums[:-1]))
    # neighbours become one code, as long as that has at most 64 bits
    width = max(int(lengths.max()), 1)
    while 2 * width <= 64:
        width *= 2
        code, sizes = (np.pad(x, (0, len(x) % 2)) for x in (code.astype(np.uint32 if width <= 32 else np.uint64, copy=False), sizes))
        code, sizes = code[::2] << sizes[1::2] | code[1::2], sizes[::2] + sizes[1::2]
    code, sizes = code.astype(np.uint64, copy=False), sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = np.zeros(total // 64 + 2, np.uint64)
    # codes are added up by the 64-bit word they begin in; at most one of a word reaches into the next
    word, over = starts >> 6, (starts & 63) + sizes - 64
    main = code << np.maximum(-over, 0).astype(np.uint64) >> np.maximum(over, 0).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.add.reduceat(main, first)
    across = np.flatnonzero(over > 0)
    words[word[across] + 1] += code[across] << (64 - over[across]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], offsets


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray],
           every: int = EVERY, longest: int = LONGEST) -> list[np.ndarray]:
    """Ids of blocks (bits, offsets, number of ids); all runs between offsets are decoded side by side."""
    ids, sizes = table
    bits = np.frombuffer(b"".join(b + b"\0\0\0\0" for b, _, _ in blocks), np.uint8)
    bases = np.cumsum([0] + [len(b) + 4 for b, _, _ in blocks[:-1]]) if blocks else []
    at = np.concatenate([np.asarray(o, np.int64) + 8 * int(base) for (_, o, _), base in zip(blocks, bases, strict=True)]
                        or [np.zeros(0, np.int64)])
    runs = np.concatenate([np.minimum(every, n - every * np.arange(len(o))) for _, o, n in blocks] or [np.zeros(0, np.int64)])
    order = np.argsort(-runs, kind="stable")  # those still going come first
    at = at[order]
    going = np.searchsorted(-runs[order], -np.arange(every), side="left")  # runs longer than k
    out = np.zeros((every, len(at)), np.uint32)
    for k in range(every):
        n = int(going[k])
        if n == 0:
            break
        here = at[:n]
        byte = here >> 3
        window = (bits[byte].astype(np.int64) << 16) | (bits[byte + 1].astype(np.int64) << 8) | bits[byte + 2]
        window = (window >> (24 - longest - (here & 7))) & ((1 << longest) - 1)
        out[k, :n] = ids[window]
        here += sizes[window]
    columns = np.empty(len(at), np.int64)
    columns[order] = np.arange(len(at))
    result, first = [], 0
    for _, offsets, n in blocks:
        mine = out[:, columns[first: first + len(offsets)]]
        result.append(mine.T.reshape(-1)[:n] if len(offsets) else np.zeros(0, np.uint32))
        first += len(offsets)
    return result


# -- writing and reading

def _flat(values: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some documents as one array that shares their memory, and where each document's begin and end."""
    if not len(values):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    values = values.cast(pa.binary())
    _, offsets, data = values.buffers()
    size = np.dtype(kind).itemsize
    bounds = np.frombuffer(offsets, np.int32)[values.offset: values.offset + len(values) + 1].astype(np.int64)
    ids = np.frombuffer(data, kind, (bounds[-1] - bounds[0]) // size, bounds[0]) if bounds[-1] > bounds[0] else np.zeros(0, kind)
    return ids, (bounds - bounds[0]) // size


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                found = np.bincount(_flat(batch["ids"].slice(at, AT_ONCE), kind)[0])
                if len(found) > len(counts):
                    counts = np.pad(counts, (0, len(found) - len(counts)))
                counts[: len(found)] += found
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])
    return run


def _encode(lengths: np.ndarray, block_ids: int, every: int, kind: str):
    codes, short = canonical(lengths).astype(np.uint32), lengths.astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        block = start = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            bits, offsets = pack(ids, codes, short, every)
            return pa.RecordBatch.from_pylist([{
                "file": file, "block": block, "start": start, "doc_ids": docs, "doc_lens": [len(p) for p in parts],
                "n_ids": len(ids), "every": every, "offsets": offsets.tolist(), "bits": bits}], BLOCKS_ARROW)

        for batch in batches:
            ids, bounds = _flat(batch["ids"], kind)
            for doc, a, b in zip(batch["doc"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                docs.append(None if doc is None else int(doc))
                parts.append(ids[a:b])
                held += len(parts[-1])
                if held >= block_ids:
                    yield close()
                    block, start, held, docs, parts = block + 1, start + held, 0, [], []
        if parts:
            yield close()
        give_back()
    return run


def write_ids(tokens: DataFrame, path: str, kind: str = "<u4", longest: int = LONGEST, block_ids: int = BLOCK_IDS,
              every: int = EVERY) -> None:
    """Write tokens (doc_id, ids of type ``kind``) in the file format, in ascending order of doc_id, NULL first, ties by ids.

    ``tokens`` is read twice, so it should be a written table. No rows give a code without ids.
    """
    spark = tokens.sparkSession
    counted = tokens.select("ids").mapInArrow(_count(kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    # one count for each id of the vocabulary
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"].astype(np.int64)] = counted["n"]
    lengths = code_lengths(counts, longest)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": used.astype(np.int64), "length": lengths[used].astype(np.int32)}),
                          "id bigint, length int").coalesce(1).write.parquet(f"{path}/code")
    ordered = (tokens.repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids"))
    (ordered.select(F.col("doc_id").cast("string").alias("doc"), "ids")
     .mapInArrow(_encode(lengths, block_ids, every, kind), BLOCKS).write.parquet(f"{path}/blocks"))


def read_ids(spark: SparkSession, path: str, longest: int = LONGEST) -> DataFrame:
    """(doc_id, start, ids) from files: start counts the ids of all documents before; ids are 32-bit little-endian."""
    code = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 0, np.int64)
    lengths[code["id"].astype(np.int64)] = code["length"]
    table = decoding_table(lengths, longest)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row per file
    per_file = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for file in sorted(per_file):
        before[file] = total
        total += per_file[file]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(batch.to_pandas().itertuples(index=False), key=lambda r: r.every)
            for every, some in _few(rows):
                decoded = unpack([(r.bits, np.asarray(r.offsets), r.n_ids) for r in some], table, every, longest)
                for r, ids in zip(some, decoded, strict=True):
                    ends = np.cumsum(np.asarray(r.doc_lens, np.int64))
                    bounds = np.concatenate(([0], ends))
                    docs = pa.array([None if d is None else str(d) for d in r.doc_ids], pa.string())
                    values = pa.Array.from_buffers(pa.binary(), len(docs), [
                        None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])
                    yield pa.RecordBatch.from_arrays([docs, pa.array(bounds[:-1] + before[r.file] + r.start), values], ["doc", "start", "ids"])
        give_back()

    return (blocks.select("file", "start", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "doc_lens", "n_ids", "every", "offsets", "bits")
            .mapInArrow(run, "doc string, start bigint, ids binary")
            .select(F.col("doc").cast("bigint").alias("doc_id"), "start", "ids"))


def _few(rows: list) -> Iterator[tuple[int, list]]:
    """Blocks of one distance of offsets, a few at once."""
    for every, same in groupby(rows, key=lambda r: r.every):
        while some := list(islice(same, BLOCKS_AT_ONCE)):
            yield every, some


def digest(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read ids."""
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, forget: bool = False) -> DataFrame:
    """Encode docs into files of the format in the shared folder, and read them back: (doc_id, start, ids).

    NULL and empty texts have the end id alone; NULL ids come first; repeated rows each have their
    ids; other columns are not read; an empty table gives none. A text is one document however long,
    and its block holds it whole. ``forget`` saves memory at the cost of time, where other stages share the processes.
    """
    spark = docs.sparkSession
    tokens = scratch(spark, "tokens")
    tokenised(docs, key, text, forget=forget).write.parquet(tokens)
    path = path or scratch(spark, "ids")
    write_ids(spark.read.parquet(tokens), path, id_type(public_tokenizers.path(VOCABULARY)))
    return read_ids(spark, path)
