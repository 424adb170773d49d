"""Removal of every repeated byte string of a length, by interval expansion on Burrows-Wheeler transforms.

A window, ``length`` bytes, is dealt by its minimizer: the leftmost of its
``length // 2``-byte strings with the smallest hash.  Equal windows have equal
minimizers, and each window of the corpus lies in exactly one *piece*, the run
of windows of a document that share one minimizer.  A minimizer that no second
piece has ends there.  Equal pieces are counted by hash, so thousands of copies
cost a row; pieces of one minimizer that differ meet in a block.

A block's pieces are suffix-sorted to the length and transformed.  Breadth-first
backward extension then goes from the strings of one byte to longer ones: the
interval of each string sets the common prefix after its end, values in
increasing order, and is extended only where it set one.  It stops at the
length; an entry not set by then is of two windows that agree in all of it.

A minimizer with more than ``HOT`` different pieces would outgrow a block; its
windows are counted one by one instead, which is exact too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

#: Length of a string whose repeats go.
LENGTH = 400

#: Different pieces of one minimizer that a block takes.
HOT = 4096

#: Bytes of a block, on average.
BLOCK_BYTES = 4 << 20

#: Bytes of a text hashed at once.
STRETCH = 1 << 22

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)

_powers: dict[str, np.ndarray] = {}


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up = np.full(size, _BASE)
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
        _powers["byte"] = np.random.default_rng(5).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
    return _powers["up"], _powers["down"]


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k``-byte string of ``x``, by content alone."""
    up, down = _scales(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_powers["byte"][x] * down[: len(x)], out=total[1:])
    h = (total[k:] - total[:-k]) * up[: len(x) - k + 1]
    h ^= h >> np.uint64(33)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, from running minima of blocks on either side."""
    n = len(v)
    full = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    full[:n] = v
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def pieces(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """``(first window, windows, minimizer, hash of the bytes)`` of every piece of a text."""
    k = max(1, length // 2)
    w = length - k + 1
    for a in range(0, len(text) - length + 1, STRETCH):
        x = np.frombuffer(text, np.uint8)[a : a + STRETCH + length - 1]
        h = gram_hashes(x, k)
        at = np.arange(len(h), dtype=np.uint64)
        low = _sliding_min((h & ~np.uint64((1 << 24) - 1)) | at, w) & np.uint64((1 << 24) - 1)
        heads = np.flatnonzero(np.diff(low, prepend=np.uint64((1 << 24) - 1)))
        ends = np.append(heads[1:], len(low))
        keys = h[low[heads].astype(np.int64)].view(np.int64)
        for s, e, key in zip(heads.tolist(), ends.tolist(), keys.tolist(), strict=True):
            own = xxhash.xxh3_64_intdigest(text[a + s : a + e + length - 1])
            yield a + s, e - s, key, own - (1 << 64) if own >> 63 else own


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols below 512 in the order of their first ``depth``, by doubling of what still ties."""
    n, first = len(x), 7
    key = np.zeros(n, np.int64)
    padded = np.append(x.astype(np.int64), np.zeros(first, np.int64))
    for j in range(first):
        key = (key << 9) | padded[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    head = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = first
    while h < depth:
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(slots):
            break
        i = sa[slots]
        after = np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
        key = rank[i] * (n + 1) + after
        order = np.argsort(key)
        i, key = i[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        sa[slots] = i
        head[slots] = new
        rank[i] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2
    return sa


def long_prefixes(x: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order agrees with the one before in ``length`` symbols; symbol 0 ends a text.

    Entries of suffixes that end before the length may be marked as well.
    """
    n = len(x)
    bwt = x[sa - 1]
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    front = x[sa]
    done = np.zeros(n + 1, bool)
    done[0] = True
    hi = np.append(np.flatnonzero(np.diff(front)), n - 1)
    lo = np.append(0, hi[:-1] + 1)
    done[hi + 1] = True
    owner = np.full(n + 2, -1, np.int64)
    base = 0
    for _ in range(length - 1):
        if not len(lo):
            break
        sizes = hi - lo + 1
        of = np.repeat(np.arange(len(lo)), sizes)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[of]
        real = bwt[rows] != 0
        to, of = lf[rows[real]], of[real] + base
        base += len(lo)
        owner[to + 1] = of
        starts = (owner[to] != of) | (front[np.maximum(to - 1, 0)] != front[to])
        ends = (owner[to + 2] != of) | (front[np.minimum(to + 1, n - 1)] != front[to])
        lo, hi = np.sort(to[starts]), np.sort(to[ends])
        fresh = ~done[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        done[hi + 1] = True
    return ~done[:n]


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows occur again in any of them, itself included."""
    lengths = np.array([len(t) for t in texts])
    x = np.zeros(int(lengths.sum()) + len(texts), np.uint16)
    starts = np.cumsum(lengths + 1) - lengths - 1
    for s, t in zip(starts.tolist(), texts, strict=True):
        x[s : s + len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 1
    sa = suffix_array(x, length)
    long = long_prefixes(x, sa, length)
    again = np.zeros(len(x), bool)
    again[sa[long | np.append(long[1:], False)]] = True
    return [again[s : s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_PIECES = "rid long, at long, n long, key long, own long"
_RUN_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_RUNS = "key long, own long, runs array<struct<a:long,b:long>>"


def _batch(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def _bytes(text: pa.Scalar) -> bytes:
    held = text.as_buffer() if text.is_valid else None
    return held.to_pybytes() if held else b""


def _cut(length: int):
    names = dict.fromkeys(("rid", "at", "n", "key", "own"), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in pieces(_bytes(text), length):
                    out.append((rid, *row))
                    if len(out) >= 1 << 16:
                        yield _batch(out, names)
                        out = []
            if out:
                yield _batch(out, names)

    return run


def _bodies(length: int):
    """Bytes of the pieces that a text is asked for."""
    names = {"key": pa.int64(), "own": pa.int64(), "copies": pa.int64(), "hot": pa.bool_(), "body": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, asked in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = _bytes(text)
                out += [(r["key"], r["own"], r["copies"], r["hot"], text[r["at"] : r["at"] + r["n"] + length - 1]) for r in asked]
                if len(out) >= 1 << 13:
                    yield _batch(out, names)
                    out = []
            if out:
                yield _batch(out, names)

    return run


def _expand(length: int):
    names = {"key": pa.int64(), "own": pa.int64(), "runs": _RUN_TYPE}

    def run(table: pa.Table) -> pa.Table:
        found = repeated_windows([b.as_py() for b in table["body"]], length)
        rows = []
        for key, own, copies, marks in zip(table["key"].to_pylist(), table["own"].to_pylist(), table["copies"].to_pylist(), found, strict=True):
            of = [(0, len(marks))] if copies > 1 else runs(marks)
            if of:
                rows.append((key, own, [{"a": a, "b": b} for a, b in of]))
        return pa.Table.from_batches([_batch(rows, names)])

    return run


def _windows(length: int):
    names = {"key": pa.int64(), "own": pa.int64(), "copies": pa.int64(), "at": pa.int64(), "w": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, copies, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                yield _batch([(key, own, copies, s, xxhash.xxh3_128_digest(body[s : s + length])) for s in range(len(body) - length + 1)], names)

    return run


def _remove(with_text: bool):
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": _RUN_TYPE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = _bytes(text)
                spans: list[list[int]] = []
                for s in sorted(found or [], key=lambda r: r["s"]):
                    if spans and s["s"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s["e"])
                    else:
                        spans.append([s["s"], s["e"]])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                rows.append((key, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"a": s, "b": e} for s, e in spans]))
                texts.append(left)
            if rows:
                out = _batch(rows, names)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(texts, pa.binary())], names=[*names, "kept"]) if with_text else out

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` what is left without the bytes of any ``length``-byte string that starts anywhere else too.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (byte
    offsets, ends exclusive) and, ``with_text``, ``kept`` (bytes, which may end
    within a character).  A null text is empty; texts shorter than ``length``
    stay whole; rows that repeat repeat each other's text, whatever their ids;
    an empty table gives no rows; other columns are not read.
    """
    docs = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    cut = written(docs.select("rid", "text").mapInArrow(_cut(length), _PIECES))
    counts = written(cut.groupBy("key", "own").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("rid", "at", "n"), F.struct("rid", "at")).alias("one")).transform(_of_shared_keys))
    whole = counts.filter("kinds = 1 and copies > 1").select("key", "own", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("one.n").alias("b"))).alias("runs"))
    asked = counts.filter("kinds > 1").select(F.col("one.rid").alias("rid"), F.struct("key", "own", "copies", (F.col("kinds") > hot).alias("hot"), F.col("one.at").alias("at"), F.col("one.n").alias("n")).alias("r"))
    asked = asked.groupBy("rid").agg(F.collect_list("r").alias("asked"))
    bodies = written(docs.select("rid", "text").join(asked, "rid").select("text", "asked").mapInArrow(_bodies(length), "key long, own long, copies long, hot boolean, body binary"))
    total = bodies.filter("not hot").agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    met = bodies.filter("not hot").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInArrow(_expand(length), _RUNS)
    windows = bodies.filter("hot").select("key", "own", "copies", "body").mapInArrow(_windows(length), "key long, own long, copies long, at long, w binary")
    again = windows.groupBy("w").agg(F.sum("copies").alias("n")).filter("n > 1").select("w")
    hot_runs = windows.join(again, "w").groupBy("key", "own").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs"))
    marks = written(whole.unionByName(met).unionByName(hot_runs))
    spans = cut.join(marks, ["key", "own"]).select("rid", F.explode("runs").alias("r"), "at").select("rid", F.struct((F.col("at") + F.col("r.a")).alias("s"), (F.col("at") + F.col("r.b") + length - 1).alias("e")).alias("s"))
    spans = spans.groupBy("rid").agg(F.collect_list("s").alias("spans"))
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>" + (", kept binary" if with_text else "")
    return docs.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_remove(with_text), kept)


def _of_shared_keys(counts: DataFrame) -> DataFrame:
    """``counts`` of minimizers in two places or more, with ``kinds``, the number of their different pieces."""
    shared = counts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all")).filter("all > 1").select("key", "kinds")
    return counts.join(shared, "key")
