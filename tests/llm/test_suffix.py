"""Repeated strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from quillspark.llm.queries import op1_suffix_dedup
from quillspark.llm.suffix import pieces, remove_repeats


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for key, t in rows:
        b = (t or "").encode()
        gone = [False] * (len(b) + 1)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        gone = gone[: len(b)]
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, small):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (8, 20, 40)]
    rows = [(1, None), (2, ""), (3, "x"), (4, "a" * 300), (4, "a" * 300), (None, "aab" * 90)]
    for k in range(60):
        own = " ".join(word() for _ in range(r.randint(0, 60)))
        rows.append((10 + k, own + r.choice(passage) + " " + word() + r.choice(passage)[: r.randint(0, 80)] + own[:20]))
    return rows if not small else rows[:3]


@pytest.mark.parametrize("hot,small,length", [(4096, False, 30), (2, False, 30), (4096, True, 30), (4096, False, 31)])
def test_against_windows(spark, hot, small, length):
    rows = texts(3, small)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, rid string")
    got = remove_repeats(docs, length, with_text=False, hot=hot, block_bytes=2000)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=repr) == brute(rows, length)


def test_pieces_cover_each_window_once():
    t = "".join(random.Random(1).choice("ab") for _ in range(500)).encode()
    found = list(pieces(t, 30))
    assert [s for s, n, _, _ in found for s in range(s, s + n)] == list(range(len(t) - 29))


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_returns_what_is_left(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(70))
    assert len(passage) >= 400
    rows = [(1, f"One é{passage} end."), (2, f"Two ĩ{passage} end."), (3, "Clean é."), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    # é and ĩ end in the same byte, so the repeated string begins within a character
    assert {k: r["text"] for k, r in got.items()} == {1: "One \ufffd", 2: "Two \ufffd", 3: "Clean é.", 4: ""}
    assert got[1]["kept_sha256"] == hashlib.sha256(b"One \xc3").hexdigest()
    assert got[3]["kept_sha256"] == hashlib.sha256("Clean é.".encode()).hexdigest()
