"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree: how often each byte followed each context of
up to ``order`` bytes in its training rows.  A byte unseen in a context costs
the context's escape probability (method C: distinct followers over total plus
distinct) and is then coded in the next shorter one, down to equal chances.
With the statistics frozen, the cost of a byte depends on nothing but its
longest known context, so the trees are laid out as one table of exact code
lengths per (context, byte, language); a text's code length in a language is a
sum of look-ups over all of its bytes, and the shortest wins.

The trees are fitted on a bounded sample of labelled rows (``ROWS`` rows a
language, of at most ``ROW_BYTES`` bytes); every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import takes_over

#: Training rows for each language.
ROWS = 500

#: Longer rows take no part in the training sample.
ROW_BYTES = 1 << 16

#: Bytes of context.
ORDER = 3

#: Cells of the cost table (contexts x symbols x languages); rarer contexts give way.
CELLS = 6_000_000

#: Positions that are scored at once.
PIECE = 1 << 18

PREDICTED = "lang_pred string, score double, bits_per_byte double"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    """Frozen trees of all languages: symbols of bytes, nodes of contexts, costs in bits."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    n_symbols: int
    children: list[np.ndarray]  # by order o >= 1: (node of order o) * symbols + older symbol -> node of order o + 1, or -1
    bases: list[int]  # first row of each order's nodes
    cost: np.ndarray  # (row * symbols + symbol, language)
    order: int

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each non-empty text (rows) under each language (columns)."""
        gap = b"\n" * self.order
        data = np.frombuffer(gap + gap.join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths + self.order) - lengths
        ends = starts + lengths
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(self.order, len(data), PIECE):
            b = min(a + PIECE, len(data))
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            if lo >= hi:
                continue
            cost = self.cost[self._cells(self.symbol[data[a - self.order : b]])]
            s, e = np.maximum(starts[lo:hi], a) - a, np.minimum(ends[lo:hi], b) - a
            edges = np.stack([s, e], 1).ravel()
            if edges[-1] == len(cost):
                edges = edges[:-1]
            total[lo:hi] += np.add.reduceat(cost, edges, axis=0)[::2]
        return total

    def _cells(self, x: np.ndarray) -> np.ndarray:
        """The row of ``cost`` for each symbol after the first ``order``."""
        d, n, m = self.order, len(x) - self.order, self.n_symbols
        node = x[d - 1 : d - 1 + n].astype(np.int32)
        row = node + self.bases[1]
        for o in range(2, d + 1):
            node = self.children[o - 2][node * m + x[d - o : d - o + n]]
            known = node >= 0
            row = np.where(known, node + self.bases[o], row)
            node = np.where(known, node, len(self.children[o - 1]) // m - 1) if o < d else node
        return row * m + x[d:]


def _grams(x: np.ndarray, keep: np.ndarray, length: int, m: int) -> np.ndarray:
    """Codes of the ``length`` symbols that end at each kept position."""
    at = np.flatnonzero(keep)
    code = np.zeros(len(at), np.int64)
    for k in range(length - 1, -1, -1):
        code = code * m + x[at - k]
    return code


def fit(rows: list[tuple[str, bytes]], order: int = ORDER, cells: int = CELLS) -> Model:
    """The trees of the languages in ``rows`` (language, text); ``order`` is at least 1."""
    langs = sorted({lang for lang, _ in rows})
    texts = {lang: [t for k, t in rows if k == lang and t] for lang in langs}
    seen = np.unique(np.frombuffer(b"\n" + b"".join(t for own in texts.values() for t in own), np.uint8))
    symbol = np.zeros(256, np.uint8 if len(seen) < 255 else np.int16)
    symbol[seen] = np.arange(1, len(seen) + 1)  # 0: bytes that training has not
    m, n_langs = len(seen) + 1, len(langs)
    gap = b"\n" * order
    own: list[tuple[np.ndarray, np.ndarray]] = []
    for lang in langs:
        data = np.frombuffer(b"".join(gap + t for t in texts[lang]), np.uint8)
        keep = np.ones(len(data), bool)
        at = 0
        for t in texts[lang]:
            keep[at : at + order] = False
            at += order + len(t)
        own.append((symbol[data].astype(np.int64), keep))
    # the contexts of each order, the most frequent ones over all languages; each one's shorter context is among them
    contexts = [np.zeros(1, np.int64), np.arange(m, dtype=np.int64)]
    room = max(0, cells // (m * max(1, n_langs)) - 1 - m)
    for o in range(2, order + 1):
        codes, counts = np.unique(np.concatenate([_grams(x, np.concatenate([keep[1:], [False]]) if len(keep) else keep, o, m) for x, keep in own]), return_counts=True)
        inside = np.isin(codes % m ** (o - 1), contexts[o - 1]) & (counts > 1)
        codes, counts = codes[inside], counts[inside]
        most = room // 4 if o < order else room
        codes = np.sort(codes[np.argsort(-counts, kind="stable")[:most]])
        room -= len(codes)
        contexts.append(codes)
    bases = np.cumsum([0, *(len(c) for c in contexts)]).tolist()
    cost = np.empty((bases[-1], m, n_langs), np.float32)
    children: list[np.ndarray] = []
    for o, codes in enumerate(contexts):
        shorter = np.searchsorted(contexts[o - 1], codes % m ** (o - 1)) + bases[o - 1] if o else None
        block = np.full((1, m, n_langs), np.log2(256.0)) if shorter is None else cost[shorter].astype(np.float64)
        for k, (x, keep) in enumerate(own):
            grams, counts = np.unique(_grams(x, keep, o + 1, m), return_counts=True)
            # a gram is its context, oldest symbol lowest in the mixed radix, then the follower
            follower, context = grams % m, grams // m
            node = np.searchsorted(codes, context)
            node[node == len(codes)] = 0
            here = codes[node] == context if len(codes) else np.zeros(0, bool)
            node, follower, counts = node[here], follower[here], counts[here].astype(np.float64)
            total = np.bincount(node, counts, len(codes))
            distinct = np.bincount(node, minlength=len(codes))
            some = total > 0
            block[some, :, k] += -np.log2(distinct[some] / (total[some] + distinct[some]))[:, None]
            block[node, follower, k] = -np.log2(counts / (total[node] + distinct[node]))
        cost[bases[o] : bases[o + 1]] = block
        if o >= 2:
            # from the node of the shorter context by the older symbol; a last row of misses stands for unknown nodes
            table = np.full((len(contexts[o - 1]) + 1) * m, -1, np.int32)
            older = codes // m ** (o - 1)
            table[(shorter - bases[o - 1]) * m + older] = np.arange(len(codes))
            children.append(table)
    children.append(np.full(m, -1, np.int32))
    return Model(langs, symbol, m, children, bases, cost.reshape(-1, n_langs), order)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, rows: int = ROWS, row_bytes: int = ROW_BYTES) -> list[tuple[str, bytes]]:
    """At most ``rows`` labelled rows a language, chosen by a hash of id and text; known to the driver.

    Bounded by languages x ``rows`` x ``row_bytes``.  Rates come from exact
    counts of all labelled rows, so no language gathers in one task.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    scale = 1 << 40
    cut = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(scale, 1 + int(1.4 * rows * scale / n))))))
    text = F.encode("text", "utf-8")
    sample = usable.filter((F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < cut[F.col("lang")]) & F.col("text").isNotNull())
    sample = sample.select("doc_id", "lang", text.alias("text")).filter(F.length("text").between(1, row_bytes))
    out: list[tuple[str, bytes]] = []
    taken: dict[str, int] = {}
    for r in sorted(sample.toLocalIterator(), key=lambda r: (r["doc_id"], bytes(r["text"]))):
        if taken.setdefault(r["lang"], 0) < rows:
            taken[r["lang"]] += 1
            out.append((r["lang"], bytes(r["text"])))
    return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predict(model, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    takes_over("langid")
    trees: Model | None = model.value
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
        lang, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        scored = [i for i, t in enumerate(texts) if has_letter(t)] if trees else []
        at = 0
        while at < len(scored):
            size, to = 0, at
            while to < len(scored) and (to == at or size < 4 * PIECE):
                size += len(texts[scored[to]])
                to += 1
            some = scored[at:to]
            length = trees.code_lengths([texts[i] for i in some])
            best = length.argmin(1)
            least = length[np.arange(len(some)), best]
            share = 1 / np.exp2(-np.minimum(length - least[:, None], 1000)).sum(1)
            for i, k in zip(some, best.tolist(), strict=True):
                lang[i] = trees.langs[k]
            score[some] = share
            bits[some] = least / np.array([len(texts[i]) for i in some])
            at = to
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=names)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``; a null text, or one without letters, is ``und`` at 0.

    ``keep`` names the columns to carry along (all but ``text`` if None; name
    ``text`` to carry it too).  ``score`` is the winner's share of the
    languages' probabilities of the whole text; ties go to the first name.
    Without a model (nothing to learn from) every row is ``und``.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(c) for c in keep), F.encode("text", "utf-8").alias("__bytes"))
    names = [*keep, "lang_pred", "score", "bits_per_byte"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__bytes"), PREDICTED])
    return rows.mapInArrow(lambda batches: _predict(held, names, batches), schema)


def identify(docs: DataFrame, rows: int = ROWS, order: int = ORDER) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out, and predict all: ``doc_id, held_out, lang_pred, score, bits_per_byte``."""
    sample = training_rows(docs, rows)
    model = fit(sample, order) if sample else None
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(own, model)
