"""Personal data: fixed rules for four kinds, and contexts learned from what they find.

Bootstrapped extraction.  The rules' entities are seeds.  A candidate is a
token with a digit or an ``@``, a run of short groups of digits, or an address
spelled out (``joe (at) site dot org``).  A pattern is up to three words left
or right of a place, or words on both sides, whatever stands there: it says
nothing of the shape.  Patterns and candidates form a bipartite graph that is
scored in rounds.  In each round patterns are induced anew from the instances
believed by then: enough different ones, and a high share among all that the
corpus has in that context, ordinary words included.  An instance is believed
as much as the best such pattern that proposes it.  Patterns of the last round
extract unseen identifiers, of kind ``found``, from every text.

Words, instances and patterns are 64-bit hashes.  Only the graph's edges, rows
of candidates, are shuffled; ordinary words in a context are counted up to the
number that disproves it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import keeps, takes_over, written

#: The kinds, in the order in which spans of one start stand.
KINDS = ("email", "ip", "card", "phone")

#: The kind of spans that learned patterns add.
FOUND = "found"

#: Distinct believed instances that a pattern must have.
SUPPORT = 5

#: Least confidence of a pattern.
CONFIDENCE = 0.8

#: Rounds of induction and scoring.
ROUNDS = 3

#: Patterns that are sent to the workers at once.
HELD = 1 << 20

#: Places of a context's words, relative to the candidate's; one word alone must be a label, such as ``card:``.
CONTEXTS = ((-1,), (-2, -1), (-3, -2, -1), (1, 2), (1, 2, 3), (-1, 1), (-2, -1, 1), (-1, 1, 2))

#: Words on either side that contexts reach.
REACH = 3

#: Least characters of a candidate, and most of each group of digits in a run.
LEAST, GROUP = 6, 6

#: Items whose contexts are hashed at once, and words that a worker remembers (under half a KB each).
ITEMS, MEMO_WORDS = 1 << 18, 1 << 17

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_IDENTIFIER = re.compile(r"[0-9@]|[(\[{]at[)\]}]|[\s(\[{]dot[\s)\]}]", re.IGNORECASE)
_MARKED = re.compile(r"[0-9@]|\w[(\[{]at[)\]}]\w", re.IGNORECASE)
_GROUPED = re.compile(r"[0-9().+/-]*[0-9][0-9().+/-]*")
_LABEL = re.compile(r"[^\W\d]{1,32}[:=](?!//)")
_AT = frozenset(("at", "(at)", "[at]", "{at}"))
_DOT = frozenset(("dot", "(dot)", "[dot]", "{dot}"))
_DIGITS = re.compile(r"[0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost and apart, in linear time.

    A match needs an ``@``; its local part is the run of allowed characters
    before it, back to the end of the match before.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the rules' matches, sorted; those that fail their test are dropped, not tried anew.

    A rule's quantifiers are possessive where giving back could not lead to a
    match, so long runs of digits cost linear time.
    """
    spans = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


def word_key(word: str) -> int:
    """Hash of a word without case and punctuation around it, but a label's sign; runs of digits are all one.

    It is odd for labels, which end in a colon or equals sign, alone.
    """
    own = word.strip(".,;!?()[]{}<>\"'").lower() or word
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", own)) & ~1 | own.endswith((":", "="))


#: What stands before and after a text, and the rules' entities as neighbours.
EDGE = word_key("edge of text")
KIND_KEYS = [word_key(f"kind {kind}") for kind in KINDS]

_memo: dict[str, int] = {}
keeps("pii", _memo.clear)


def _keys(words: list[str]) -> list[int]:
    got = [*map(_memo.get, words)]
    if None in got:
        for k, key in enumerate(got):
            if key is None:
                if len(_memo) >= MEMO_WORDS:
                    _memo.clear()
                got[k] = _memo[words[k]] = word_key(words[k])
    return got


def _spelled(tokens: list[str], k: int) -> int:
    """The end of the address whose name is token ``k`` and whose ``@`` and dots are words; ``k`` if there is none."""
    if k + 2 >= len(tokens) or (at := tokens[k + 1].lower()) not in _AT:
        return k
    end = k + 3
    while end + 1 < len(tokens) and tokens[end].lower() in _DOT:
        end += 2
    dotted = end > k + 3 or "." in tokens[k + 2].strip(".")
    # a bare "at" is a preposition unless the dots are spelled too
    return end if dotted and (at != "at" or end > k + 3) else k


def items(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[tuple[int, int, int, bool]]]:
    """Keys of a text's items, and (item, start, end, whether a rule found it) of the candidates among them.

    Tokens that a span touches count as one item and stand for the span; so do
    the tokens of other candidates.
    """
    if not _IDENTIFIER.search(text):
        return _keys(text.split()), []
    places = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[s:e] for s, e in places]
    words: list[str] = []
    keys: list[tuple[int, int]] = []  # item, key of those that are no words
    marks: list[tuple[int, int, int, bool]] = []
    k = j = done = 0
    # spans of a start or a token in common are one item
    merged: list[list[int]] = []
    for s, kind, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, kind, e])
    while k < len(tokens):
        s, e = places[k]
        while j < len(merged) and merged[j][2] <= s:
            j += 1
        if j < len(merged) and merged[j][0] < e:
            start, kind, end = merged[j]
            if any(c.isalpha() for c in text[max(s, done) : start]):
                words.append(text[max(s, done) : start])
            marks.append((len(words), start, end, True))
            keys.append((len(words), KIND_KEYS[kind]))
            words.append("")
            j, done = j + 1, end
            # what is left of its last token belongs to it, unless another span begins there
            while k < len(tokens) and places[k][0] < end:
                k += 1
            if j < len(merged) and merged[j][0] < places[k - 1][1]:
                k -= 1
            continue
        end = _spelled(tokens, k)
        if end == k and not _MARKED.search(tokens[k]):
            words.append(tokens[k])
            k += 1
            continue
        # a candidate ends before the next span
        stop = merged[j][0] if j < len(merged) else len(text)
        if end > k and places[end - 1][1] > stop:
            end = k
        if end == k:
            end = k + 1
            if len(tokens[k]) <= GROUP and _GROUPED.fullmatch(tokens[k]):
                while end < len(tokens) and places[end][1] <= stop and tokens[end - 1][-1] not in ",;:!?":
                    group = tokens[end].rstrip(".,;:!?")
                    if len(group) > GROUP or not _GROUPED.fullmatch(group):
                        break
                    end += 1
        if end == k + 1 and (label := _LABEL.match(tokens[k])) and e - s - label.end() >= LEAST:
            words.append(label[0])
            s += label.end()
        raw = text[s : places[end - 1][1]]
        first = s + len(raw) - len(raw.lstrip("\"'([{<"))
        last = s + len(raw.rstrip(".,;:!?\"')]}>"))
        if last - first >= LEAST:
            marks.append((len(words), first, last, False))
        words.append(text[s : places[end - 1][1]])
        k = end
    out = _keys(words)
    for i, key in keys:
        out[i] = key
    return out, marks


def contexts(keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``CONTEXTS``, the patterns at the places ``at`` of ``keys``, and whether they have a word, or label.

    ``keys`` has ``REACH`` edges between texts and at both ends.
    """
    for k, offsets in enumerate(CONTEXTS):
        h = np.full(len(at), k + 1, np.uint64)
        worded = np.zeros(len(at), bool)
        for d in offsets:
            x = keys[at + d]
            worded |= x != EDGE if len(offsets) > 1 else x % 2 == 1
            h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield h.view(np.int64), worded


def _joined_texts(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, bool, str]]]]:
    """Keys of many texts in a row with edges between, and (item, start, end, seed, text) of their candidates."""
    keys: list[int] = [EDGE] * REACH
    marks: list[tuple[int, int, int, bool, str]] = []
    for text in texts:
        own, found = items(text, base_spans(text))
        marks += [(len(keys) + i, s, e, seed, text) for i, s, e, seed in found]
        keys += own
        keys += [EDGE] * REACH
        if len(keys) >= ITEMS:
            yield np.array(keys, np.uint64), marks
            keys, marks = [EDGE] * REACH, []
    if len(keys) > REACH:
        yield np.array(keys, np.uint64), marks


EDGES = "instance long, seed boolean, pattern long"


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    takes_over("pii")
    for batch in batches:
        texts = (t for v in batch.column(0) if (t := v.as_py()) and _IDENTIFIER.search(t))
        for keys, marks in _joined_texts(texts):
            if not marks:
                continue
            at = np.array([m[0] for m in marks])
            instance = np.array([xxhash.xxh3_64_intdigest(t[s:e]) for _, s, e, _, t in marks], np.uint64).view(np.int64)
            seed = np.array([m[3] for m in marks])
            for pattern, worded in contexts(keys, at):
                yield pa.RecordBatch.from_arrays([pa.array(instance[worded]), pa.array(seed[worded]), pa.array(pattern[worded])], names=["instance", "seed", "pattern"])


def _ordinary_rows(held):
    """Rows (pattern, filler) of the ordinary words in the contexts held; (pattern, null) where they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("pii")
        patterns, limit = held.value
        bits = (1 << 22) - 1
        likely = np.zeros(bits + 1, bool)
        likely[patterns & bits] = True
        alive = np.ones(len(patterns), bool)
        fillers: dict[int, set[int]] = {}
        for batch in batches:
            for keys, marks in _joined_texts(t for v in batch.column(0) if (t := v.as_py())):
                ordinary = keys != EDGE
                ordinary[[m[0] for m in marks]] = False
                at = np.flatnonzero(ordinary)
                for pattern, _ in contexts(keys, at):
                    some = np.flatnonzero(likely[pattern & bits])
                    slot = np.minimum(np.searchsorted(patterns, pattern[some]), len(patterns) - 1)
                    hit = (patterns[slot] == pattern[some]) & alive[slot]
                    if not hit.any():
                        continue
                    pairs = np.unique(np.stack([slot[hit], keys[at[some[hit]]].view(np.int64)], 1), axis=0)
                    which, n = np.unique(pairs[:, 0], return_counts=True)
                    alive[which[n > limit[which]]] = False
                    for k, filler in pairs[alive[pairs[:, 0]]].tolist():
                        own = fillers.setdefault(k, set())
                        own.add(filler)
                        if len(own) > limit[k]:
                            alive[k] = False
        rows = [(k, f) for k, own in fillers.items() if alive[k] for f in own]
        gone = np.flatnonzero(~alive)
        slots = np.concatenate([np.array([k for k, _ in rows], np.int64), gone])
        if len(slots):
            yield pa.RecordBatch.from_arrays([pa.array(patterns[slots]), pa.array([f for _, f in rows] + [None] * len(gone), pa.int64())], names=["pattern", "filler"])

    return run


def _array(patterns: DataFrame) -> np.ndarray:
    """The rows of whole numbers, sorted by the first."""
    rows = np.array([tuple(r) for r in patterns.toLocalIterator()], np.int64).reshape(-1, len(patterns.columns))
    return rows[np.argsort(rows[:, 0])]


def learn(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """The believed patterns of a corpus, as rows ``pattern``.

    Every edge of every text counts.  A pattern's confidence is the sum of its
    distinct instances' beliefs over their number, that of the distinct
    ordinary words found in its place, and one; a seed is believed wholly, any
    other instance by the best believed pattern that proposes it.
    """
    spark = docs.sparkSession
    graph = written(docs.select("text").mapInArrow(_edge_rows, EDGES).distinct())
    # no round can believe more instances than there are, nor a pattern with more ordinary words than this
    most = F.floor(F.col("n") / confidence - F.col("n") - 1 + 1e-9)
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).select("pattern", "n", most.alias("most"))
    sizes = written(sizes.filter((F.col("n") >= support) & (F.col("most") >= 0)))
    # a longer list goes in slices, each over all texts, so nothing is dropped
    slices = -(-sizes.count() // HELD)
    if not slices:
        return sizes.select("pattern")
    counted = []
    for k in range(slices):
        listed = _array(sizes.filter(F.pmod("pattern", F.lit(slices)) == k).select("pattern", "most"))
        if len(listed):
            held = spark.sparkContext.broadcast((listed[:, 0].copy(), listed[:, 1].copy()))
            counted.append(written(docs.select("text").mapInArrow(_ordinary_rows(held), "pattern long, filler long")))
            held.destroy()
    ordinary = reduce(DataFrame.unionByName, counted)
    words = ordinary.groupBy("pattern").agg(F.countDistinct("filler").alias("words"), F.max(F.col("filler").isNull()).alias("gone"))
    live = sizes.join(words, "pattern", "left").filter("not coalesce(gone, false) and coalesce(words, 0) <= most")
    live = written(graph.join(live.select("pattern", F.coalesce("words", F.lit(0)).alias("words")), "pattern"))
    believed = live.select("pattern", "words", "instance", "seed", F.col("seed").cast("double").alias("belief"))
    for k in range(rounds):
        share = F.sum("belief") / (F.count(F.lit(1)) + F.first("words") + 1)
        scored = believed.groupBy("pattern").agg(F.count_if(F.col("belief") > 0).alias("n"), share.alias("confidence"))
        strong = written(scored.filter((F.col("n") >= support) & (F.col("confidence") >= confidence)).select("pattern", "confidence"))
        if k == rounds - 1:
            break
        proposed = live.join(strong, "pattern").groupBy("instance", "seed").agg(F.max("confidence").alias("best"))
        belief = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
        believed = written(live.join(proposed, ["instance", "seed"], "left").select("pattern", "words", "instance", "seed", belief.alias("belief")))
    return strong.select("pattern")


def proposals(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(start, end) of the candidates that no rule found, and their patterns (candidates x contexts)."""
    if not _IDENTIFIER.search(text):
        return [], np.zeros((0, len(CONTEXTS)), np.int64)
    own, marks = items(text, base)
    marks = [m for m in marks if not m[3]]
    if not marks:
        return [], np.zeros((0, len(CONTEXTS)), np.int64)
    keys = np.array([*[EDGE] * REACH, *own, *[EDGE] * REACH], np.uint64)
    found = contexts(keys, np.array([m[0] for m in marks]) + REACH)
    return [(s, e) for _, s, e, _ in marks], np.stack([h for h, _ in found], 1)


def spans_of(text: str, believed: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The rules' spans, and all spans with those that the believed patterns (sorted) add outside of them."""
    base = base_spans(text)
    if not len(believed):
        return base, base
    places, patterns = proposals(text, base)
    if not places:
        return base, base
    slot = np.minimum(np.searchsorted(believed, patterns), len(believed) - 1)
    more = [(s, len(KINDS), e) for (s, e), yes in zip(places, (believed[slot] == patterns).any(1).tolist(), strict=True) if yes]
    return base, sorted(base + more) if more else base


def _text_key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "replace"))


def _proposal_rows(at: int):
    """Rows (text, start, end, pattern) of a column's texts, each text by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(at):
                if (text := v.as_py()) and _IDENTIFIER.search(text):
                    places, patterns = proposals(text, base_spans(text))
                    rows += [(_text_key(text), s, e, p) for (s, e), own in zip(places, patterns.tolist(), strict=True) for p in own]
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "start", "end", "pattern"])

    return run


def _with_spans(docs: DataFrame, believed: DataFrame, column: str):
    """``docs`` and the function that gives a batch's texts their spans, (the rules', all).

    The patterns go to the workers; where there are more than ``HELD``, the
    candidates are joined to them instead, and ``docs`` gets their places as a
    last column.
    """
    at = docs.columns.index(column)
    if believed.count() <= HELD:
        held = docs.sparkSession.sparkContext.broadcast(_array(believed)[:, 0])

        def known(batch: pa.RecordBatch) -> Iterator[tuple]:
            for v in batch.column(at):
                yield spans_of(v.as_py() or "", held.value)

        return docs, known
    places = docs.select(column).mapInArrow(_proposal_rows(0), "key binary, start long, end long, pattern long")
    places = places.join(believed.distinct(), "pattern", "left_semi").select("key", "start", "end").distinct()
    places = written(places.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("__places")))
    keyed = F.udf(lambda t: _text_key(t) if t else None, "binary")
    joined = docs.withColumn("__key", keyed(column)).join(places.withColumnRenamed("key", "__key"), "__key", "left").select(*docs.columns, "__places")

    def looked_up(batch: pa.RecordBatch) -> Iterator[tuple]:
        for v, own in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            base = base_spans(v.as_py() or "")
            yield base, sorted(base + [(p["start"], len(KINDS), p["end"]) for p in own]) if own else base

    return joined, looked_up


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, FOUND)[k]}:{s}:{e}" for s, k, e in spans)


DETECTED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long"


def detect(docs: DataFrame, believed: DataFrame) -> DataFrame:
    """Spans of every text: the counts and checksum are those of the rules' spans, ``spans`` has all of them.

    One row per row of ``docs``; a null text is an empty one.
    """
    rows, spans = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), believed, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, every in spans(batch):
                n = [0] * len(KINDS)
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", *(f.split()[0] for f in DETECTED.split(", "))],
            )

    return rows.mapInArrow(run, f"doc_id long, {DETECTED}")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by ``<kind>`` of its first."""
    out, done, last = [], 0, -1
    for s, k, e in spans:
        if s < last:
            last = max(last, e)
            continue
        if last >= 0:
            done = last
        out += [text[done:s], f"<{(*KINDS, FOUND)[k]}>"]
        last = e
    return "".join([*out, text[last:]]) if last >= 0 else text


def redact(docs: DataFrame, believed: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the spans of ``column`` replaced; other columns and null texts stay as they are."""
    at, names = docs.columns.index(column), docs.columns
    rows, spans = _with_spans(docs, believed, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact_text(t, every) if (t := v.as_py()) else t for v, (_, every) in zip(batch.column(at), spans(batch), strict=True)]
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
