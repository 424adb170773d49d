"""Harmonic packing of token sequences.

A document gives full sequences first.  What remains, fewer tokens than the
capacity, belongs to the class ``k = capacity // length``: every such piece is
longer than ``capacity / (k + 1)``, and a bin of the class is closed when it
has its fixed count, ``k`` pieces.  What a closed bin lacks is less than
``capacity / (k + 1)``; a later remainder that fits goes there whole, and when
``PENDING`` closed bins wait, one remainder is cut to fill their largest gaps.
Nothing else is cut.  Every task fills the bins of its own classes; nothing is
shuffled or shared.

At its end a task has less than a bin of each class left.  Those pieces fill
the waiting gaps and then sequences in a row; the last tokens go to sequences
whose totals are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import default_vocabulary, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens array<int>"

#: Sequences of one task at most; the partition's number stands above these bits.
TASK_BITS = 40

#: Closed bins of a task that wait for pieces of their gaps' length.
PENDING = 256

#: A closed bin that lacks fewer tokens than this is padded.
SLACK = 8

#: (document, first token, ids, tokens of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class Bins:
    """The open and the waiting bins of one task: at most one of each class, and ``PENDING``, of ``capacity`` tokens each."""

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[tuple[int, int]] = []  # (gap, number), sorted
        self.held: dict[int, list[Piece]] = {}
        self.lacking = 0

    def _sequence(self, pieces: list[Piece]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield piece, self.next, at
            at += len(piece[2])
        self.next += 1

    def _close(self, pieces: list[Piece]) -> Iterator[tuple]:
        """Emit a bin that is full, or have it wait."""
        gap = self.capacity - sum(len(p[2]) for p in pieces)
        if gap < SLACK:
            yield from self._sequence(pieces)
            return
        self.held[self.next] = pieces
        insort(self.waiting, (gap, self.next))
        self.next += 1
        self.lacking += gap

    def _fill(self, k: int, piece: Piece) -> Iterator[tuple]:
        """Add a piece to the waiting bin in place ``k``."""
        gap, number = self.waiting.pop(k)
        pieces = self.held[number]
        pieces.append(piece)
        self.lacking -= len(piece[2])
        gap -= len(piece[2])
        if gap >= SLACK:
            insort(self.waiting, (gap, number))
            return
        self.lacking -= gap
        del self.held[number]
        at = 0
        for p in pieces:
            yield p, number, at
            at += len(p[2])

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n = len(ids)
        at = n - n % self.capacity
        for s in range(0, at, self.capacity):
            yield from self._sequence([(key, s, ids[s : s + self.capacity], n)])
        if at == n:
            return
        # a copy, so a long document's other ids need not be held
        piece = (key, at, ids[at:].copy() if at else ids[at:], n)
        k = bisect_left(self.waiting, (n - at, -1))
        if k < len(self.waiting):
            yield from self._fill(k, piece)
        elif len(self.waiting) >= PENDING and self.lacking >= n - at:
            yield from self._cut(piece)
        else:
            kind = self.capacity // (n - at)
            bin_ = self.open.setdefault(kind, [])
            bin_.append(piece)
            if len(bin_) == kind:
                del self.open[kind]
                yield from self._close(bin_)

    def _cut(self, piece: Piece) -> Iterator[tuple]:
        """Deal a piece over the largest gaps, no more of it than they take together."""
        key, start, ids, n = piece
        while len(ids):
            size = min(len(ids), self.waiting[-1][0])
            yield from self._fill(len(self.waiting) - 1, (key, start, ids[:size], n))
            start, ids = start + size, ids[size:]

    def close(self) -> Iterator[tuple]:
        """What is left: gaps first, then sequences in a row, the last ones of power-of-two totals."""
        loose = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -len(p[2]))
        self.open.clear()
        rest = []
        for piece in loose:
            k = bisect_left(self.waiting, (len(piece[2]), -1))
            if k < len(self.waiting):
                yield from self._fill(k, piece)
            elif self.lacking >= len(piece[2]):
                yield from self._cut(piece)
            else:
                rest.append(piece)
        # bins that nothing can fill any more stand in the row themselves; their numbers stay unused
        rest += [p for pieces in self.held.values() for p in pieces]
        self.held.clear()
        self.waiting.clear()
        left = sum(len(p[2]) for p in rest)
        own: list[Piece] = []
        room = self._room(left)
        for key, start, ids, n in rest:
            while len(ids):
                size = min(len(ids), room)
                own.append((key, start, ids[:size], n))
                start, ids, left, room = start + size, ids[size:], left - size, room - size
                if not room:
                    yield from self._sequence(own)
                    own, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0


def _pack(vocabulary: str, end_id: int, capacity: int, with_tokens: bool):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    kept = len(names) if with_tokens else len(names) - 1

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds[:kept], strict=True)], names=list(names[:kept]))

    def row(piece: Piece, number: int, at: int) -> tuple:
        key, start, ids, n = piece
        found = (key, start, len(ids), zlib.crc32(memoryview(ids).cast("B")), n, number, at)
        return (*found, ids.astype(np.int32)) if with_tokens else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        bins = Bins(capacity, TaskContext.get().partitionId() << TASK_BITS)
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []
        most = 1_000 if with_tokens else 20_000
        for batch in batches:
            texts = batch.column(1)
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids = np.concatenate([enc.ids(texts[i].as_py() or ""), end]).astype("<u4", copy=False)
                for found in bins.add(key, ids):
                    rows.append(row(*found))
                    if len(rows) >= most:
                        yield table(rows)
                        rows = []
        for found in bins.close():
            rows.append(row(*found))
        if rows:
            yield table(rows)

    fields = dict(f.rsplit(" ", 1) for f in PIECES.split(", "))
    return run, ", ".join(f"{name} {fields[name]}" for name in names[:kept])


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 1, with_tokens: bool = True) -> DataFrame:
    """Pack ``docs`` (``doc_id``, ``text``; more columns are ignored) into sequences of at most ``capacity`` tokens.

    ``capacity`` is a power of two.  One row per piece, with its ids where
    ``with_tokens``; a null or empty text is the end id alone, repeated rows
    are packed as often as they stand, and no rows give none; a text of any
    length is encoded as a whole.  Sequence numbers are unique, not
    consecutive: the task's number above ``TASK_BITS`` bits, then a count.  No
    shuffle: a task reads its rows once and holds a bin of each class and
    ``PENDING`` more.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    run, schema = _pack(vocabulary or default_vocabulary(), end_id, capacity, with_tokens)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
