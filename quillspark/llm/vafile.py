"""Exact top-k search by inner product with vector-approximation (VA) files.

Components are whole numbers, ``floor(1024 * x)``.  Every vector has an
approximation of one byte a dimension: the number of a cell of that
dimension's grid, which starts at ``low`` and has cells of one width, both kept
with the vectors of a batch.  A search scans approximations first.  A cell
holds each component to an interval, so each query gets a lower and an upper
bound of its product with every vector; vectors whose upper bound is under the
k-th best lower bound are out.  The rest are read exactly in descending order
of upper bound, until the k-th best exact score tops every bound to come.

Queries travel in blocks of bounded size, one after the other; each block runs
against all partitions of vectors, a partition gives at most ``k`` rows a
query, and a merge keeps the ``k`` best.

Floating point keeps products exact up to a bound on the components.  Vectors
beyond it are *wide*: they have no cells, and whatever meets one is scored in
whole numbers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import shared_dir, written

#: Fixed value of the contract: components are floor(SCALE * x).
SCALE = 1024

#: Queries that are sent at once, on average; at most this many times the dimensions are broadcast.
BLOCK = 2048

#: Cells of a dimension.
CELLS = 64

#: Vectors whose bounds are held at once.
ROWS = 4096

#: Exact vectors that a query reads between two looks at its k-th score.
STEP = 32

#: The ends of the score column.
MOST = 2**63 - 1

#: Scores lie within ``2**SPAN``, as doubles are under 2**1024 and dimensions under 2**31.
SPAN = 2 * (1024 + 10) + 32

#: ``beyond`` is empty for a score within ``MOST``; else it orders such scores, highest first.
NEIGHBOURS = "query_id long, vec_id long, score long, beyond binary"

FILE = "vec_id long, dims int, cells binary, low binary, width binary, exact binary, wide boolean"


def usable(vector: str) -> Column:
    """Not null, not empty, and all components finite numbers."""
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def whole(x: np.ndarray) -> np.ndarray:
    """Components as whole numbers."""
    return np.floor(SCALE * x.astype(np.float64)).astype(np.int64)


def wide_whole(x: np.ndarray) -> np.ndarray:
    """Components as whole numbers of any size."""
    # a double of 2**52 or more is a whole number, and its product with SCALE may be none
    return np.array([[SCALE * int(v) if abs(v) >= 2.0**52 else math.floor(SCALE * v) for v in row] for row in x.tolist()], object)


def bound(d: int) -> float:
    """Size of components up to which products of ``d`` of them, and of the corners of their cells, stay exact in floating point."""
    return math.sqrt(2.0**53 / (4 * d)) / 4 - CELLS


def beyond(score: int) -> bytes:
    return b"" if abs(score) < MOST else ((1 << SPAN) - score).to_bytes(SPAN // 8 + 1, "big")


def index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The VA file, a table ``FILE`` of every usable vector.

    ``low`` and ``width`` (by dimension) are those of the batch, so nothing is
    fitted beforehand and the bounds hold for every row whatever its values.  A
    wide vector has none; its ``exact`` holds the components as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for d in np.unique(dims).tolist():
                rows = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = _matrix(rows.column(1), d).astype(np.float64)
                wide = np.abs(x).max(1) >= bound(d) / SCALE
                for some in (False, True):
                    if not (own := np.flatnonzero(wide == some)).size:
                        continue
                    n = len(own)
                    if some:
                        grid, cells, exact = [pa.nulls(n, pa.binary())] * 2, pa.nulls(n, pa.binary()), x[own].astype("<f8")
                    else:
                        exact = whole(x[own])
                        low = exact.min(0)
                        width = np.maximum(1, -(-(exact.max(0) - low + 1) // CELLS))
                        cells = pa.array([c.tobytes() for c in ((exact - low) // width).astype(np.uint8)], pa.binary())
                        grid = [pa.array([a.astype("<i8").tobytes()] * n, pa.binary()) for a in (low, width)]
                        exact = exact.astype("<i8")
                    at = pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(at), rows.column(2).take(at), cells, *grid, pa.array([e.tobytes() for e in exact], pa.binary()), pa.array([some] * n)],
                        names=[f.split()[0] for f in FILE.split(", ")],
                    )

    rows = vectors.filter(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.size(vector).alias("dims"))
    return rows.filter(F.col("vec_id").isNotNull()).mapInArrow(run, FILE)


def nearest(ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, exact, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """For each query the (vec_id, score) of the ``k`` best rows, ties to the smaller id; rows of the query's own id are left out.

    ``exact(rows)`` reads exact vectors; it is asked for those alone whose
    bounds leave them a chance.
    """
    corner = low + cells.astype(np.int64) * width
    reach = np.maximum(width - 1, 0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    base = (queries.astype(np.float64) @ corner.T.astype(np.float64)).astype(np.int64)  # whole numbers under 2**53
    upper = base + (plus @ reach)[:, None]
    lower = base + (minus @ reach)[:, None]
    for j, q in enumerate(query_ids.tolist()):
        own = ids != q
        n = int(own.sum())
        if not n:
            continue
        at = np.flatnonzero(own)
        if n > k:
            least = np.partition(lower[j][at], n - k)[n - k]
            at = at[upper[j][at] >= least]
        at = at[np.argsort(-upper[j][at], kind="stable")]
        best: list[tuple[int, int]] = []  # (-score, vec_id)
        for s in range(0, len(at), STEP):
            if len(best) == k and upper[j][at[s]] < -best[-1][0]:
                break
            some = at[s : s + STEP]
            scores = exact(some) @ queries[j]
            best = sorted([*best, *zip((-scores).tolist(), ids[some].tolist(), strict=True)])[:k]
        yield q, best


def _read(exact: list[bytes], wide: bool, d: int) -> np.ndarray:
    """Vectors of the file as whole numbers."""
    x = np.frombuffer(b"".join(exact), "<f8" if wide else "<i8").reshape(-1, d)
    return wide_whole(x) if wide else x


def _dealt(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    q, v, score = zip(*out, strict=True)
    shown = [max(-MOST, min(MOST, s)) for s in score]
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(shown, pa.int64()), pa.array([beyond(s) for s in score], pa.binary())], names=["query_id", "vec_id", "score", "beyond"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Rows of the file by dimensions and width, ``ROWS`` at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            dims, wide = np.asarray(piece.column(1)), np.asarray(piece.column(6))
            for d in np.unique(dims).tolist():
                for some in np.unique(wide[dims == d]).tolist():
                    yield d, some, piece.take(pa.array(np.flatnonzero((dims == d) & (wide == some))))


def _in_whole(q: int, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The ``k`` best of ``vectors`` for one query, scored in whole numbers of any size."""
    scores = vectors.astype(object) @ own.astype(object)
    best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:k]
    return [(q, i, -s) for s, i in best]


def _against(held, k: int):
    """Tasks that give each query of the block ``held`` its ``k`` best vectors of a piece of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, wide, rows in _pieces(batches):
            ids, vectors = np.asarray(rows.column(0)), rows.column(5)
            out: list[tuple[int, int, int]] = []
            for other in (False, True):
                if (d, other) not in held.value:
                    continue
                qi, q = held.value[d, other]
                if wide or other:
                    exact = _read(vectors.to_pylist(), wide, d)
                    for one, own in zip(qi.tolist(), q, strict=True):
                        out += _in_whole(one, own, ids, exact, k)
                    continue
                join = lambda c, t, rows=rows, d=d: np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(-1, d)
                cells, grid = join(2, np.uint8), np.concatenate([join(3, "<i8"), join(4, "<i8")], 1)
                for g in np.unique(grid, axis=0):
                    which = np.flatnonzero((grid == g).all(1))
                    read = lambda some, which=which, d=d: _read([vectors[int(i)].as_py() for i in which[some]], False, d)
                    for one, best in nearest(ids[which], cells[which], g[:d], g[d:], read, qi, q, k):
                        out += [(one, i, -s) for s, i in best]
            if out:
                yield _dealt(out)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best vectors for every row of ``queries``.

    Vectors that are null, empty, or hold null or non-finite components take
    no part on either side; a vector of other dimensions than the query's is
    no candidate.  Rows that repeat an id count each; a query's own id does
    not.  Fewer candidates than ``k`` give fewer rows, an empty table none.
    Other columns are not read.  Ranks go by exact scores; one that no long can
    hold is shown as the nearest long.
    """
    spark = vectors.sparkSession
    file = written(index(vectors, vec_id, vector))
    asked = written(index(queries, vec_id, vector).select("vec_id", "dims", "exact", "wide").dropDuplicates(["vec_id", "exact", "wide"]))
    blocks = max(1, -(-asked.count() // block))
    path = shared_dir(spark)
    for b in range(blocks):
        # one block at a time is on the driver and in the executors, whatever the number of queries
        own: dict[tuple[int, bool], tuple[list, list]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toLocalIterator():
            ids, rows = own.setdefault((r["dims"], r["wide"]), ([], []))
            ids.append(r["vec_id"])
            rows.append(bytes(r["exact"]))
        held = spark.sparkContext.broadcast({key: (np.array(i, np.int64), _read(x, key[1], key[0])) for key, (i, x) in own.items()})
        file.mapInArrow(_against(held, k), NEIGHBOURS).write.mode("append").parquet(path)
        held.destroy()
    found = spark.read.schema(NEIGHBOURS).parquet(path)
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "beyond", "vec_id")))
    # two steps, so a query's rows meet in one task only after each of several has kept its k best
    split = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    some = found.groupBy("query_id", split.alias("part")).agg(F.slice(best, 1, k).alias("best"))
    some = some.select("query_id", F.explode("best").alias("b")).select("query_id", "b.s", "b.beyond", "b.vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("s", "beyond", "vec_id"))
    return some.select("query_id", rank.alias("rank"), "vec_id", (-F.col("s")).alias("score")).filter(F.col("rank") <= k)
