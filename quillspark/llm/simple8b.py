"""Token-id output: Simple-8b word-aligned coding in blocks.

A 64-bit word holds a selector in its top four bits and, below, as many ids as
the selector's width allows.  A block is one row of a Parquet table: whole
documents in ascending ``doc_id`` order, their lengths, the words, the index of
the first word of every ``STRIDE`` words together with the ids before it (so a
reader can start in the middle), and escapes for values of more than 60 bits.

Parquet is the container because Spark's committer then makes the output
survive lost executors and speculative tasks on any file system; the payload
column is stored as it is, without a second compression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, shared_dir
from quillspark.llm.tokens import default_vocabulary, encoder

#: Fixed values of the coding: ids to a word and bits to an id, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

#: A block is closed when it has as many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 17

#: Words between two entries of a block's offsets.
STRIDE = 1024

BLOCKS = (
    "part int, block int, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
    "words binary, offsets array<long>, escape_at array<long>, escape_value array<decimal(20,0)>"
)

FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Bits of small values, filled when first asked for.
_SMALL = np.zeros(1 << 17, np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each value below 2**60, rounded up to those of a selector."""
    limits = np.array([1 << b for b in sorted(set(BITS))], np.uint64)
    steps = np.array(sorted(set(BITS)), np.uint8)
    if not len(ids) or int(ids.max()) >= len(_SMALL):
        return steps[np.searchsorted(limits, ids, side="right")]
    if not _SMALL[-1]:
        _SMALL[:] = steps[np.searchsorted(limits, np.arange(len(_SMALL), dtype=np.uint64), side="right")]
    return _SMALL[ids]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, offsets (ids before every ``STRIDE``-th word), escaped places and their values.

    Greedy: each word takes the selector with the most ids that fit.  The end
    of the block counts as zeros, which the reader drops by the block's length.
    """
    ids = np.asarray(ids, np.uint64)
    big = ids >= np.uint64(1 << 60)
    escape_at, escape_value = np.flatnonzero(big), ids[big]
    if len(escape_at):
        ids = ids.copy()
        ids[big] = 0
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), escape_at, escape_value
    padded = np.zeros(n + COUNTS[0], np.uint64)
    padded[:n] = ids
    width = _widths(padded)
    # widest[i]: the most bits that any of the c ids from i on takes, made from shorter runs; a selector that
    # takes more ids has fewer bits, so what fits it fits all those of fewer ids too
    selector = np.full(n, 15, np.uint8)
    widest, have = width, 1
    for s in range(14, -1, -1):
        step = COUNTS[s] - have
        # have < COUNTS[s] <= 2 * have holds for each count of the table
        widest = np.maximum(widest[: len(widest) - step], widest[step:])
        have = COUNTS[s]
        fits = widest[:n] <= BITS[s]
        if not fits.any():
            break
        selector -= fits
    step = np.array(COUNTS, np.uint8)[selector].tobytes()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        if not BITS[s]:
            continue
        which = np.flatnonzero(chosen == s)
        total = np.zeros(len(which), np.uint64)
        for k in range(COUNTS[s]):
            total |= padded[starts[which] + k] << np.uint64(k * BITS[s])
        words[which] |= total
    return words, starts[::STRIDE], escape_at, escape_value


def decode(words: np.ndarray, n: int, escape_at: np.ndarray, escape_value: np.ndarray, offsets: np.ndarray, first: int = 0) -> np.ndarray:
    """The values from ``first`` to ``n`` of those that :func:`encode` had.

    Whole stretches of ``STRIDE`` words are decoded at once; their offsets say
    where each begins, so only those that hold the values asked for are read.
    """
    offsets = np.asarray(offsets, np.int64)
    if first >= n or not len(offsets):
        return np.zeros(0, np.uint64)
    low = int(np.searchsorted(offsets, first, side="right")) - 1
    high = int(np.searchsorted(offsets, n, side="left"))
    words = np.asarray(words, np.uint64)[low * STRIDE : high * STRIDE]
    base = int(offsets[low])
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.zeros(-(-len(words) // STRIDE) * STRIDE, np.int64)
    counts[: len(words)] = np.array(COUNTS, np.int64)[chosen]
    ends = np.cumsum(counts.reshape(-1, STRIDE), axis=1)
    starts = ((ends - counts.reshape(-1, STRIDE)) + (offsets[low:high] - base)[:, None]).ravel()[: len(words)]
    out = np.zeros(int(starts[-1] + counts[len(words) - 1]), np.uint64)
    for s in np.unique(chosen).tolist():
        if not BITS[s]:
            continue
        which = np.flatnonzero(chosen == s)
        own, to, mask = words[which], starts[which], np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[to + k] = (own >> np.uint64(k * BITS[s])) & mask
    out = out[first - base : n - base]
    at = np.asarray(escape_at, np.int64)
    if len(at):
        some = (at >= first) & (at < n)
        out[at[some] - first] = np.asarray(escape_value, np.uint64)[some]
    return out


def _blocks(vocabulary: str, end_id: int, block_ids: int):
    schema = pa.schema(
        [
            ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("words", pa.binary()),
            ("offsets", pa.list_(pa.int64())), ("escape_at", pa.list_(pa.int64())), ("escape_value", pa.list_(pa.decimal128(20, 0))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        docs: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        held = first = block = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            words, offsets, at, value = encode(ids)
            row = {
                "part": part, "block": block, "first": first, "n_ids": len(ids), "doc_ids": list(docs), "doc_tokens": list(lengths),
                "words": words.astype("<u8").tobytes(), "offsets": offsets.tolist(), "escape_at": at.tolist(), "escape_value": [int(v) for v in value],
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1)
            for i, key in enumerate(keys):
                ids = enc.ids(texts[i].as_py() or "")
                docs.append(key)
                lengths.append(len(ids) + 1)
                parts += [ids, end]
                held += len(ids) + 1
                if held >= block_ids:
                    yield close()
                    first, block, held = first + held, block + 1, 0
                    docs.clear(), lengths.clear(), parts.clear()
        if parts:
            yield close()

    return run


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            b = {name: batch.column(name)[row].as_py() for name in ("first", "base", "n_ids", "doc_ids", "doc_tokens", "words", "offsets", "escape_at", "escape_value")}
            value = np.array([int(v) for v in b["escape_value"]], np.uint64)
            ids = decode(np.frombuffer(b["words"], "<u8"), b["n_ids"], np.array(b["escape_at"], np.int64), value, np.array(b["offsets"], np.int64)).astype("<u4")
            n = np.array(b["doc_tokens"], np.int64)
            ends = np.cumsum(n)
            starts = ends - n
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b["doc_ids"], pa.int64()), pa.array(starts + (b["base"] + b["first"])), pa.array(n), pa.array(crc, pa.int64())], schema=schema
            )


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``; more columns are ignored) to ``path``.

    Range-partitioned and sorted by ``doc_id`` (nulls first), a hash of the
    text and the row's place, so part by part and block by block the ids stand
    in ascending order, and the rows of one id, were they a third of all, are
    dealt over many parts.  A null text is an empty one; a task holds one block
    and one Arrow batch, and a longer text is a block of its own.
    """
    spark = docs.sparkSession
    order = ("doc_id", "hash", "place")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = rows.mapInArrow(_blocks(vocabulary or default_vocabulary(), end_id, block_ids), BLOCKS)
    blocks.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the blocks at ``path``: its place among all ids, their number and checksum.

    The ids before a part come from a running sum over one row per part (a
    file of a write job); only that table of two longs a part is broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(base), "part").mapInArrow(_found, FOUND)


def token_output(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and return what reading them back finds.

    An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_ids(docs, path, vocabulary, end_id)
    return read_ids(spark, path)
