"""Near-duplicate components against all pairs of a small fixture."""

import random
import re

import numpy as np
import pytest

from quillspark.llm import jaccard
from quillspark.llm.jaccard import jaccard_components


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                root[b] = a
    return sorted((r[0], len(s), rows[top(i)][0]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, words, percent):
    r = random.Random(words)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO")]
    base = [[f"w{r.randrange(300)}" for _ in range(r.randint(20, 120))] for _ in range(12)]
    for k in range(150):
        own = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = f"x{r.randrange(9)}"
        rows.append((10 + k, " ".join(own)))
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, cls string")
    assert sorted(map(tuple, jaccard_components(docs, words, percent).collect())) == brute(rows, words, percent)


def test_copies_that_are_alike_but_not_enough(spark):
    """Many edited copies of one text of which few link, one line in all texts, and ids that repeat or are null."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(250):
        own = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            own[r.randrange(60)] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    line = "this very line stands in all of the texts"
    rows += [(1000 + k, f"{line} " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(3, 30)))) for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, 3, 90).collect())) == brute(rows, 3, 90)
    odd = [(1, rows[0][1]), (1, "other words stand here"), (None, rows[0][1]), (None, "alone and without an id"), (2, "other words stand here"), (1, rows[0][1])]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(odd, "doc_id long, text string"), 3, 90).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 1), (1, 1)], key=str)


def test_few_pairs_of_copies_that_do_not_link(spark, monkeypatch):
    """Copies of one text, each edited at another place, none of which link: bitmaps keep most pairs from being tested."""
    rows = []
    for k in range(32):
        own = [f"w{j}" for j in range(100)]
        own[3 * k + 2] = f"e{k}"
        rows.append((k, " ".join(own)))
    tested, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda pairs, sets, percent: (tested.append(pairs.count()), links(pairs, sets, percent))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, 3, 90).collect())) == brute(rows, 3, 90)
    assert sum(tested) < 250, tested


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(50):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 900)).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.integers(0, 300) :], r.integers(0, 2**63, r.integers(0, 50)).astype(np.uint64)]))
        bits = int(np.bitwise_count(jaccard.bitmap(x).view(np.uint64) ^ jaccard.bitmap(y).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y)) and (bits == 0) == (len(np.setxor1d(x, y)) == 0)


def test_whole_sets_are_not_dealt_to_be_indexed(spark, monkeypatch):
    """Sets of shingles are read where they lie: no join of the second index has them on a side."""
    rows = []
    for k in range(32):
        own = [f"w{j}" for j in range(100)]
        own[3 * k + 2] = f"e{k}"
        rows.append((k, " ".join(own)))
    sides, written = [], jaccard.written

    def joined(node):
        below = [node.children().apply(k) for k in range(node.children().size())]
        for x in below:
            if node.nodeName() == "Join":
                sides.append({x.output().apply(k).name() for k in range(x.output().size())})
            joined(x)

    def seen(df):
        if "before" in df.columns and "comp" not in df.columns:
            joined(df._jdf.queryExecution().optimizedPlan())
        return written(df)

    monkeypatch.setattr(jaccard, "written", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, 3, 90).collect())) == brute(rows, 3, 90)
    assert sides and not any({"light", "heavy"} & x for x in sides), sides


def test_tokens_that_are_alike_lose_no_link(spark, monkeypatch):
    """Shingles whose packed hashes and numbers of texts are the same make entries meet, and the links stay."""
    monkeypatch.setattr(jaccard, "TOKEN_BITS", 3)
    monkeypatch.setattr(jaccard, "MANY", 2)
    r = random.Random(9)
    rows = []
    for k in range(120):
        own = [f"w{j}" for j in range(60)]
        for _ in range(r.choice((1, 1, 2, 3))):
            own[r.randrange(60)] = f"e{r.randrange(40)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, 3, 90).collect())) == brute(rows, 3, 90)
