"""License scans against an alignment of every template at every place."""

import random

from quillspark.llm.licenses import COVERAGE, TEMPLATES, Index, align, scan_licenses
from quillspark.llm.licenses import _WORD

R = random.Random(4)
FILL = [f"w{k}" for k in range(50)]


def filler(n):
    return " ".join(R.choice(FILL) for _ in range(n))


def brute(text):
    words = [w.lower() for w in _WORD.findall(text)]
    out = set()
    for name, texts in TEMPLATES.items():
        for t in texts:
            own = _WORD.findall(t.lower())
            if any(align(own, words, d)[0] >= COVERAGE * len(own) for d in range(-len(own), len(words))):
                out.add(name)
    return out


def test_planted_notices(spark):
    rows, want = [], {}
    for k, (name, texts) in enumerate(TEMPLATES.items()):
        for j, t in enumerate(texts):
            key = 100 * k + j
            words = t.split()
            if len(words) > 20:
                words[len(words) // 2] = "changed"
            rows.append((key, f"{filler(30)}\n{' '.join(words)}\n{filler(20)}", "x"))
            want[key] = name
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, filler(5000), "x"), (9004, "two words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = scan_licenses(docs).collect()
    assert {r.doc_id: r.license for r in got} == want
    for r in got:
        assert r.license in brute(rows[[x[0] for x in rows].index(r.doc_id)][1])
        text = dict((a, b) for a, b, _ in rows)[r.doc_id]
        assert text[r.start : r.end].split()[0].strip('("') in TEMPLATES[r.license][r.template]


def test_repeats_and_empty(spark):
    text = "Released under the MIT License. " * 2
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(r.license, r.coverage) for r in scan_licenses(docs).collect()] == [("MIT", 1.0)] * 4
    assert scan_licenses(docs.limit(0)).count() == 0
    assert Index({}).scan(text, 0.8, {}) == []


def test_copies_side_by_side():
    """A notice right after one that lacks words, and one that drifts after a failed place."""
    text = TEMPLATES["MIT"][0]
    own = text.split()
    long = next(t for texts in TEMPLATES.values() for t in texts if len(t.split()) >= 25).split()
    index = Index({"x": [" ".join(long)]})
    found = index.scan(" ".join(long[5:] + long), COVERAGE, {})
    assert len(found) == 2 and found[1][2] == 1.0
    failed = filler(3).split() + long[: len(long) // 3] + filler(6).split()
    assert [f[2] for f in index.scan(" ".join(failed + long), COVERAGE, {})] == [1.0]
    assert len(Index({"y": [text]}).scan(" ".join(own * 3), COVERAGE, {})) == 3
