"""N-gram Jaccard self-join by grouped prefixes.

A document is the set of its distinct word shingles.  Under one total order of
shingles, two sets whose Jaccard similarity reaches ``percent`` share ``c``
shingles among the first ``n - ceil(percent * n / 100) + c`` of each, ``c`` the
smaller of ``COMMON`` and the overlap that they need.  Documents with
the same prefix and size form one group, so an index entry stands for all of
them; group pairs pass a size and a position filter, and only then members are
taken apart and verified on their whole texts.

The order puts shingles that are frequent somewhere in the corpus last, the
rest by hash.  Any total order gives the same links, so counting heavy hitters
alone is a matter of speed.

Links make components, and a component does not need all of its pairs.  Round
one verifies for every group one likely partner, the hub: of the groups in an
index entry, the one that shares most entries with others, which in a cluster
of edited copies is the text that they were made from.  Classes of one group
meet the group's first.

Round two has to find every link between two components of round one.  Texts
that share entries with another component are indexed anew, now with shingles
in order of their number among these texts, so an edited copy's own shingles
stand first.  A prefix that they fill has no similar text at all.  A pair is
made where its first common shingle can be, and only if bitmaps of the whole
sets do not differ in more bits than similar sets may differ in shingles.
So texts that are alike, but not enough, are told apart by the index and not by
pairs, and pairs inside a component are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import forget, takes_over, written
from quillspark.llm.graph import components

#: A shingle is heavy where it is in this share of some batch of documents.
HEAVY_SHARE = 1 / 1000

#: Heavy shingles in the order at most, the most frequent ones.
HEAVY = 1 << 16

#: Shingles of a batch for heavy hitters.
BATCH_SHINGLES = 1 << 21

#: Common shingles that prefixes are long enough to show; a pair with fewer is no candidate.
COMMON = 4

#: Bytes of a text whose words are hashed at once.
WINDOW = 1 << 18

#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 64

#: Slices in which entries are dealt by shingle.
SLICES = 4

#: Parts over which entries of one heavy shingle are dealt.
PARTS = 64

#: Entries that are met one by one to see whether groups have enough in common.
FEW = 16

#: Rounds of likely pairs between components, before all that are left are tested; the links found are the same whatever their number.
ROUNDS = 1

#: Bits of a shingle's hash in the tokens of the second index, and the most classes that their order tells apart.
TOKEN_BITS, MANY = 43, (1 << 20) - 1

#: A list of classes whose texts are asked for is broadcast if it has no more rows (of 24 bytes).
ASKED = 1 << 19

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=np.uint64)
    space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    upper = (byte >= ord("A")) & (byte <= ord("Z"))
    return space, _mixed((byte + np.uint64(32) * upper + np.uint64(1)) * _PRIME)


#: Whether a byte is white space, and its value in a word's hash.
_SPACE, _VALUE = _byte_tables()

_FIRST = np.zeros(1, np.int64)

#: Powers of the prime and of its inverse modulo 2**64.
_POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(WINDOW, _PRIME)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(WINDOW, np.uint64(pow(int(_PRIME), -1, 1 << 64)))]))


def word_hashes(data: bytes, space: np.ndarray = _SPACE) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, in order; ``space`` marks the bytes between words.

    A word's hash is a polynomial of its bytes, read off running sums of the
    window; windows end between words.
    """
    out, at, raw = [], 0, np.frombuffer(data, np.uint8)
    while at < len(raw):
        part = raw[at : at + WINDOW]
        gaps = np.flatnonzero(space[part])
        if at + len(part) < len(raw) and not (len(gaps) and gaps[-1] == len(part) - 1):
            if not len(gaps):  # one word that fills the window
                end = at + len(part)
                while end < len(raw) and not space[raw[end]]:
                    end += 1
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].lower())], np.uint64))
                at = end
                continue
            part = part[: gaps[-1] + 1]
        starts, ends = np.concatenate([_FIRST, gaps + 1]), np.concatenate([gaps, [len(part)]])
        if (empty := starts == ends).any():
            starts, ends = starts[~empty], ends[~empty]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * _POWER[: len(part)], out=sums[1:])
        h = _mixed((sums[ends] - sums[starts]) * _INVERSE[starts])
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            h[k] = xxhash.xxh3_64_intdigest(data[at + starts[k] : at + ends[k]].lower())
        out.append(h)
        at += len(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one, a text without words none."""
    own = word_hashes((text or "").encode())
    if not len(own):
        return own
    size = min(words, len(own))
    n = len(own) - size + 1
    h = own[:n] + np.uint64(size)
    for k in range(1, size):
        h *= _PRIME
        h += own[k : k + n]
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def needed(n: int, percent: int) -> int:
    """Common shingles that the prefix of a set of ``n`` shows with any similar set."""
    return min(COMMON, -(-percent * n // 100))


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + needed(n, percent)


def _heavy(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("jaccard")
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            some = count >= max(4, HEAVY_SHARE * len(held))
            return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(count[some].astype(np.int64))], names=["token", "n"])

        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), words))
                size += len(held[-1])
                if size >= BATCH_SHINGLES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def heavy_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The heavy shingles of a corpus from rare to frequent; ``HEAVY`` at most.  Every text is counted."""
    found = docs.select("text").mapInArrow(_heavy(words), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(HEAVY).select("token").toLocalIterator()
    return np.fromiter((r[0] for r in rows), np.int64)[::-1].copy().view(np.uint64)


def parted(h: np.ndarray, by_hash: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that are not heavy, and the sorted ranks of those that are."""
    if not len(by_hash):
        return h, np.zeros(0, np.int64)
    at = np.searchsorted(by_hash, h)
    at[at == len(by_hash)] = 0
    common = by_hash[at] == h
    return h[~common], np.sort(place[at[common]])


SETS = "doc_id long, n_shingles long, cls binary, grp binary, prefix array<long>, light int"


def _sets(words: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("jaccard")
        frequent = heavy.value
        place = np.argsort(frequent)
        by_hash = frequent[place]
        for batch in batches:
            n, cls, grp, prefix, light = [], [], [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py(), words)
                n.append(len(h))
                cls.append(xxhash.xxh3_128_digest(h.tobytes()))
                if not len(h):
                    grp.append(b"")
                    prefix.append(None)
                    light.append(0)
                    continue
                length = prefix_length(len(h), percent)
                first, ranks = parted(h, by_hash, place)
                light.append(min(len(first), length))
                if len(first) < length and len(ranks):
                    first = np.concatenate([first, frequent[ranks]])
                first = first[:length]
                grp.append(xxhash.xxh3_128_digest(first.tobytes() + len(h).to_bytes(8, "little")))
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(grp, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(light, pa.int32())],
                names=["doc_id", "n_shingles", "cls", "grp", "prefix", "light"],
            )

    return run


#: Words of a set's bitmap.
BITMAP = tuple(f"b{k}" for k in range(8))

ARRAYS = "id long, light array<long>, heavy array<int>, " + ", ".join(f"{b} long" for b in BITMAP)


def bitmap(h: np.ndarray) -> np.ndarray:
    """The parity of the shingles that fall on each bit: two sets differ in as many shingles as their bitmaps in bits, or more."""
    bits = 64 * len(BITMAP)
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _arrays(words: int, heavy):
    """Whole shingle sets of texts: those that are not heavy by hash, and the ranks of those that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("jaccard")
        place = np.argsort(heavy.value)
        by_hash = heavy.value[place]
        for batch in batches:
            some = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for s in range(0, batch.num_rows, some):
                part = batch.slice(s, some)
                whole = [shingles(t.as_py(), words) for t in part.column(1)]
                sets = [parted(h, by_hash, place) for h in whole]
                light, ranks = (pa.array([x[k].view(np.int64) for x in sets], pa.list_(pa.int64())) for k in (0, 1))
                maps = np.stack([bitmap(h) for h in whole]).T
                yield pa.RecordBatch.from_arrays([part.column(0), light, ranks.cast(pa.list_(pa.int32())), *(pa.array(m) for m in maps)], names=["id", "light", "heavy", *BITMAP])

    return run


def _shingle_sets(need: DataFrame, leads: DataFrame, docs: DataFrame, words: int, heavy) -> DataFrame:
    """The table ``ARRAYS`` of the classes in ``need`` (``id``), each read from one of its texts."""
    rows = written(leads.join(need.distinct(), "id"))
    small = F.broadcast(rows) if rows.count() <= ASKED else rows
    return written(docs.join(small, "row").select("id", "text").mapInArrow(_arrays(words, heavy), ARRAYS))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The class pairs ``a, b`` whose sets are similar."""
    side = lambda c: sets.select(F.col("id").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("light", "heavy")))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = sum((F.size(f"{k}_{c}") for k in ("light", "heavy") for c in "ab"), F.lit(0))
    both = F.size(F.array_intersect("light_a", "light_b")) + F.size(F.array_intersect("heavy_a", "heavy_b"))
    return written(met.select("a", "b", both.alias("both"), sizes.alias("sizes")).filter(f"{100 + percent} * both >= {percent} * sizes").select("a", "b"))


def similar(n_x: str, n_y: str, at_x: str, at_y: str, percent: int, before_x: str | None = None, before_y: str | None = None) -> str:
    """SQL: sizes fit, and the shingles before and after a common one can still make up the needed overlap.

    ``before`` counts those before it that any other set has; all may be common without it.
    """
    most = f"least({before_x or at_x}, {before_y or at_y}) + 1 + least({n_x} - {at_x} - 1, {n_y} - {at_y} - 1)"
    return f"100 * least({n_x}, {n_y}) >= {percent} * greatest({n_x}, {n_y}) and {100 + percent} * ({most}) >= {percent} * ({n_x} + {n_y})"


def alike(n_x: str, n_y: str, x: str, y: str, percent: int) -> str:
    """SQL: the bitmaps of ``x`` and ``y`` differ in no more bits than similar sets may differ in shingles."""
    bits = " + ".join(f"bit_count({x}_{b} ^ {y}_{b})" for b in BITMAP)
    return f"{100 + percent} * ({bits}) <= {100 - percent} * ({n_x} + {n_y})"


def enough(n_x: str | Column, n_y: str | Column, percent: int) -> Column:
    """Common prefix shingles that a similar pair shows at least: :func:`needed` of the smaller set."""
    return F.least(F.lit(COMMON), F.ceil(F.least(n_x, n_y) * percent / 100))


def _undecided(entries: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The groups ``grp`` that may be similar to one of another component, by their ``entries``.

    Where a shingle has ``FEW`` entries at most, common ones are counted by
    pair.  Other shingles are looked at by sizes that fit: with ``FEW`` entries
    at most they are counted by pair as well, else an entry counts as common
    with whatever group has most.
    """
    own = entries.select("token", "grp", "n", "at").join(parts, "grp")
    ends = (F.count(F.lit(1)).alias("met"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    step = float(np.log(100 / percent)) * 1.000001 if percent < 100 else 1e-6
    mixed = own.groupBy("token").agg(*ends).filter("low != high").select("token", (F.col("met") <= FEW).alias("few"))
    every = written(own.join(mixed, "token").withColumn("size", F.floor(F.log("n") / step)))
    sides = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    cells = every.groupBy("token", "size").agg(*ends).select("token", sides.alias("size"), "met", "low", "high")
    met = cells.groupBy("token", "size").agg(F.sum("met").alias("met"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high")
    # what has no other component beside its size goes, whatever the number of entries
    own = written(every.join(met.select("token", "size", "met"), ["token", "size"]))
    forget(every)
    listed = own.filter("few").groupBy("token").agg(F.collect_list(F.struct("grp", "n", "at", "comp")).alias("y"))
    pairs = listed.select(F.explode("y").alias("x"), "y").select("x", F.explode("y").alias("y"))
    pairs = pairs.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("grp", "n", "at", "comp")))
    own = own.filter("not few")
    x = own.filter(F.col("met") <= FEW)
    # only the few entries beside those are dealt to them
    beside = x.select("token", F.col("size").alias("of")).distinct().select("token", "of", F.explode(F.array(F.col("of") - 1, F.col("of"), F.col("of") + 1)).alias("size"))
    y = own.join(beside, ["token", "size"]).select("token", F.col("of").alias("size"), *(F.col(c).alias(f"y_{c}") for c in ("grp", "n", "at", "comp")))
    x = x.select("token", "size", *(F.col(c).alias(f"x_{c}") for c in ("grp", "n", "at", "comp")))
    pairs = pairs.unionByName(x.join(y, ["token", "size"]).drop("token", "size")).filter("x_comp != y_comp and " + similar("x_n", "y_n", "x_at", "y_at", percent))
    counted = pairs.groupBy(F.col("x_grp").alias("grp"), "y_grp").agg(F.count(F.lit(1)).alias("c"), F.first("x_n").alias("n")).groupBy("grp").agg(F.max("c").alias("c"), F.first("n").alias("n"))
    many = own.filter(F.col("met") > FEW).groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    both = counted.unionByName(many).groupBy("grp").agg(F.sum("c").alias("c"), F.first("n").alias("n"))
    return both.filter(F.col("c") >= enough("n", F.ceil(F.col("n") * percent / 100), percent)).select("grp")


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """Entries ``token, is_heavy, id, n, at, before`` of classes by their whole ``sets``.

    Shingles that one class has alone are no entries, but they count as the
    first places; heavy ones are the last.  A prefix has one shingle more than
    a similar set may lack.  Only single shingles are dealt, never whole sets.

    A shared shingle's token has its number of classes (``MANY`` at most) above
    ``TOKEN_BITS`` of its hash, so tokens sort by that number; hashes alike in
    those bits may only make entries meet that have nothing in common.
    """
    rows = sets.withColumn("n", (F.size("light") + F.size("heavy")).cast("long")).withColumn("length", F.col("n") + F.floor(-F.col("n") * percent / 100) + 1)
    single = rows.select("id", F.explode("light").alias("token"))
    shared = single.select("id", "token", F.count(F.lit(1)).over(Window.partitionBy("token")).alias("df")).filter("df > 1")
    packed = F.expr(f"shiftleft(least(df, {MANY}L), {TOKEN_BITS}) | (token & {(1 << TOKEN_BITS) - 1}L)")
    own = shared.select("id", packed.alias("token")).groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("own"))
    light = rows.select("id", "n", "length", F.size("light").alias("lights")).join(own, "id")
    # those that are alone fill the first places
    light = light.withColumn("alone", F.col("lights") - F.size("own")).filter("alone < length")
    light = light.select("id", "n", "alone", F.posexplode(F.expr("slice(own, 1, cast(length - alone as int))")).alias("k", "token"))
    light = light.select("token", F.lit(False).alias("is_heavy"), "id", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("k").alias("before"))
    heavy = rows.filter("size(heavy) > 0 and size(light) < length").select("id", "n", "length", F.size("light").alias("lights"), F.posexplode("heavy").alias("k", "rank"))
    heavy = heavy.withColumn("at", F.col("lights") + F.col("k")).filter("at < length").select(F.col("rank").cast("long").alias("token"), F.lit(True).alias("is_heavy"), "id", "n", "at", "k")
    heavy = heavy.join(own.select("id", F.size("own").alias("shared")), "id", "left").select("token", "is_heavy", "id", "n", "at", (F.coalesce("shared", F.lit(0)) + F.col("k")).alias("before"))
    return written(light.unionByName(heavy))


def _in_several(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """``entries`` with their ``comp`` of ``comps`` (``id, comp``), of shingles in several components, with the one that has ``most``."""
    of = ["token", "is_heavy"]
    own = entries.join(comps, "id")
    parts = own.groupBy(*of, "comp").agg(F.count(F.lit(1)).alias("c")).groupBy(*of).agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"))
    return written(own.join(parts.filter("comps > 1").drop("comps"), of))


def _tries(parts: DataFrame, seed: int, percent: int) -> DataFrame:
    """For each class one class ``y`` of another component that is likely to be similar: of those that one order puts first in a shingle, the one met most."""
    of = ["token", "is_heavy"]
    key = F.struct(F.xxhash64("id", F.lit(seed)), "id")
    fields = F.struct("id", "n", "at", "before", "comp")
    inside = parts.filter("comp = most").groupBy(*of).agg(F.max_by(fields, key).alias("y"))
    outside = parts.filter("comp != most").groupBy(*of).agg(F.max_by(fields, key).alias("y"))
    met = parts.filter("comp != most").join(inside, of).unionByName(parts.join(outside, of)).filter("comp != y.comp and id != y.id")
    met = met.filter(similar("n", "y.n", "at", "y.at", percent, "before", "y.before")).groupBy("id", F.col("y.id").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("id").agg(F.max_by("y", F.struct("c", "y")).alias("y")).select(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y")).distinct()


def _between(parts: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs ``x, y`` of classes in different components; a shingle's largest one is met by the others, never by itself.

    A similar pair meets in the first shingle that it has in common, before
    which nothing is, so no shingle counts what stands before it; and the
    bitmaps of ``maps`` (``id`` and ``BITMAP``) bound the shingles in which
    the two differ.
    """
    of = ["token", "is_heavy"]
    parts = parts.join(maps, "id")
    fields = ("id", "n", "at", "comp", *BITMAP)
    x = parts.filter("comp != most").select(*of, "most", *(F.col(c).alias(f"x_{c}") for c in fields))
    y = parts.select(*of, *(F.col(c).alias(f"y_{c}") for c in fields))
    first = similar("x_n", "y_n", "x_at", "y_at", percent, "0", "0") + " and " + alike("x_n", "y_n", "x", "y", percent)
    met = x.join(y, of).filter("x_comp != y_comp and (y_comp = most or x_id < y_id) and " + first)
    return met.select(F.least("x_id", "y_id").alias("x"), F.greatest("x_id", "y_id").alias("y")).distinct()


def _bridges(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``ca, cb`` between components of ``left`` (``id, comp``) that join all that any link joins.

    Likely pairs are tested first, one of each class, and components joined by
    them are one for the next round; after
    ``ROUNDS`` every pair that is left between two components is tested.
    """
    entries = _index(sets, percent)
    comps, found = left, None
    for k in range(ROUNDS + 1):
        parts = _in_several(entries, comps)
        pairs = _tries(parts, k, percent) if k < ROUNDS else _between(parts, sets.select("id", *BITMAP), percent)
        links = _links(written(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))), sets, percent)
        for c in "ab":
            links = links.join(left.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")), c)
        links = written(links.select("ca", "cb"))
        found = links if found is None else found.unionByName(links)
        if k < ROUNDS and not links.isEmpty():
            joined = components(found, "ca", "cb").select(F.col("node").alias("comp"), "component")
            comps = written(left.join(joined, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")))
    return found


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``; more columns are ignored).

    Two rows link when ``100 * intersection >= percent * union`` of their
    shingle sets; ``component_id`` is the smallest ``doc_id`` that links reach.
    A null text, or one without words, has no shingles and links with nothing.
    Rows that repeat an id count each; a row without an id takes part, and its
    component is null only if no row of it has an id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy = spark.sparkContext.broadcast(heavy_shingles(docs, words))
    sets = written(docs.mapInArrow(_sets(words, percent, heavy), SETS))
    slim = written(sets.select("doc_id", "n_shingles", "cls"))
    full = sets.filter("n_shingles > 0")
    # a class: rows of one shingle set; its text is found again by a row that has the set
    classes = written(full.groupBy("cls", "grp", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("lead")))
    lead, numbered = "lead", docs.withColumnRenamed("doc_id", "row")
    if not sets.filter("doc_id is null").isEmpty() or sets.groupBy("doc_id").count().filter("count > 1").count():
        # ids do not tell rows apart: find texts by the checksum of their shingle sets
        key = docs.mapInArrow(_keyed(words), "row binary, text string")
        lead, numbered = "cls", key.dropDuplicates(["row"])
    # numbers of groups and classes are written with them, so later tasks that are run again read the same ones
    groups = written(full.groupBy("grp").agg(F.first("prefix").alias("prefix"), F.first("light").alias("light"), F.first("n_shingles").alias("n")).withColumn("gid", F.monotonically_increasing_id()))
    classes = written(classes.join(groups.select("grp", "gid"), "grp").select(F.monotonically_increasing_id().alias("id"), "cls", F.col("gid").alias("grp"), "lead"))
    leads = classes.select("id", F.col(lead).alias("row"))
    forget(sets)
    sets = slim
    full = sets.filter("n_shingles > 0")
    slices = []
    for k in range(SLICES):
        # shingle by shingle range, so the shuffle of one slice ends before the next
        some = groups.select(F.col("gid").alias("grp"), "n", "light", F.posexplode("prefix").alias("at", "token")).filter(F.pmod(F.xxhash64("token"), F.lit(SLICES)) == k)
        some = some.withColumn("part", F.when(F.col("at") >= F.col("light"), F.pmod("grp", F.lit(PARTS))))
        some = some.select("token", "grp", "n", "at", "part", F.count(F.lit(1)).over(Window.partitionBy("token", "part")).alias("df"))
        # a heavy shingle is taken to be in several groups
        slices.append(written(some.filter("df > 1 or part is not null").drop("part")))
    entries = reduce(DataFrame.unionByName, slices)
    forget(groups)
    # round one: the hub with most common entries, and the first class of the own group
    first = classes.groupBy("grp").agg(F.min("id").alias("top"))
    scores = entries.groupBy("grp").agg(F.sum(F.col("df") - 1).alias("score"))
    hubs = entries.join(scores, "grp").groupBy("token").agg(F.max(F.struct("score", "grp", "n", "at")).alias("hub"))
    near = entries.join(hubs, "token").select("grp", "n", "at", F.col("hub.grp").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at"), "hub.score")
    near = near.filter("grp != hub and " + similar("n", "hub_n", "at", "hub_at", percent))
    near = near.groupBy("grp", "hub").agg(F.count(F.lit(1)).alias("c"), F.first(enough("n", "hub_n", percent)).alias("least"), F.first("score").alias("score")).filter("c >= least")
    near = near.groupBy("grp").agg(F.max_by("hub", F.struct("c", "score", "hub")).alias("near"))
    tops = first.join(near, "grp").select(F.col("top").alias("a"), F.col("near").alias("grp")).join(first, "grp").select("a", F.col("top").alias("b"))
    inner = classes.join(first, "grp").filter("id != top").select(F.col("id").alias("a"), F.col("top").alias("b"))
    tested = written(tops.unionByName(inner))
    asked = _shingle_sets(tested.select(F.explode(F.array("a", "b")).alias("id")), leads, numbered, words, heavy)
    rough = components(_links(tested, asked, percent))
    forget(asked)
    labelled = classes.join(rough.withColumnRenamed("node", "id"), "id", "left").select("id", "cls", "grp", "lead", F.coalesce("component", "id").alias("comp"))
    labelled = written(labelled)
    # round two: what is left between components
    parts = labelled.select("grp", "comp").distinct()
    several = parts.groupBy("grp").count().filter("count > 1").select("grp")
    some = _undecided(entries, parts, percent)
    left = written(labelled.join(some.unionByName(several).distinct(), "grp").select("id", "comp"))
    forget(entries)
    asked = _shingle_sets(left.select("id"), leads, numbered, words, heavy)
    bridges = _bridges(left, asked, percent)
    forget(asked)
    merged = components(bridges, "ca", "cb").select(F.col("node").alias("comp"), "component")
    final = labelled.join(merged, "comp", "left").select("cls", "lead", F.coalesce("component", "comp").alias("comp"))
    ids = final.groupBy("comp").agg(F.min("lead").alias("component_id"))
    ids = final.join(ids, "comp").select("cls", "component_id")
    found = full.select("doc_id", "n_shingles", "cls").join(ids, "cls").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _keyed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(shingles(t.as_py(), words).tobytes()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(1)], names=["row", "text"])

    return run
