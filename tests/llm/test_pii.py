"""Patterns that personal data are learned by: what they add, and what they leave."""

from quillspark.llm import pii
from quillspark.llm.pii import detect, learn, redact


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, out = dict(rows), {}
    for r in detect(docs, learn(docs)).collect():
        spans = [x.split(":") for x in r["spans"].split(",") if x.startswith("found:")]
        assert r["n_found"] == len(spans)
        out[r["doc_id"]] = [texts[r["doc_id"]][int(s) : int(e)] for _, s, e in spans]
    return out


CARDS = [n for k in range(1000) if pii.luhn(n := f"4111{k:04d}22223333")]
SEEDS = [(k, f"for help call me at +44 20 7946 {1000 + k} now, or else write") for k in range(100)]
SEEDS += [(1000 + k, f"his mail: user{k}@site{k}.org is known") for k in range(100)]
SEEDS += [(2000 + k, f"paid with card: {number} last week") for k, number in enumerate(CARDS)]


def test_unseen_forms_in_learned_contexts(spark):
    unseen = {
        300: ("for help call me at 555-123-4567 now, or else write", ["555-123-4567"]),
        301: ("for help call me at 555 123 4567 now, or else write", ["555 123 4567"]),
        302: ("his mail: joe (at) site dot org is known", ["joe (at) site dot org"]),
        303: ("paid with card: C01X00T47 last week", ["C01X00T47"]),
        304: ("paid with card:AB-99-1234 last week", ["AB-99-1234"]),
    }
    clean = {
        400: "the part 555-123-4567 is in stock",
        401: "we met (at) site dot org",
        402: "version 12.4.1099 of C01X00T47 was built",
        403: "call 555-123-4567",
        404: "he was seen at 10:30:15 in town",
    }
    rows = [*SEEDS, *((k, t) for k, (t, _) in unseen.items()), *clean.items()]
    got = found(spark, rows)
    assert {k: got[k] for k in unseen} == {k: want for k, (_, want) in unseen.items()}
    assert {k: v for k, v in got.items() if v and k not in unseen} == {}


def test_contexts_of_ordinary_words_are_not_learned(spark):
    rows = [(k, f"w{'x' * (k % 9)} the +44 20 7946 {1000 + k} y{'z' * (k % 7)}") for k in range(30)]
    rows += [(100 + k, f"sees the {'abcdefghij'[k] * 5} here") for k in range(10)] + [(200, "in the 555-123-4567 here")]
    assert found(spark, rows)[200] == []


def test_instances_believed_induce_patterns(spark):
    ids = [f"X-{7000 + k}-Q" for k in range(20)]
    ways = ("paid with card: {} last week", "for help call me at {} now, or else write", "his mail: {} is known")
    rows = [*SEEDS, *((500 + k, ways[k % 3].format(x)) for k, x in enumerate(ids))]
    rows += [(600 + k, f"passport no {x} issued") for k, x in enumerate(ids)] + [(700, "passport no X-9999-Q issued")]
    got = found(spark, rows)
    assert got[700] == ["X-9999-Q"] and got[500] == [ids[0]]


def test_small_context_beside_a_hot_source(spark):
    hot = [(5000 + k, " ".join(f"{k:03x}{j:03x}9" for j in range(4000))) for k in range(200)]
    phones = [(k, f"reach us on +44 20 7946 {1000 + k} today") for k in range(8)]
    rows = [*phones, (900, "reach us on 555-123-4567 today")]
    assert found(spark, rows)[900] == found(spark, rows + hot)[900] == ["555-123-4567"]


def test_patterns_that_outgrow_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([*SEEDS, *SEEDS[:5], (900, "paid with card: C01X00T47 last week"), (None, "his mail: joe (at) site dot org is known"), (901, None)], "doc_id long, text string")
    texts = lambda d: sorted(map(str, d.collect()))
    want = texts(detect(docs, learn(docs))), texts(redact(docs, learn(docs)))
    assert sum("<found>" in x for x in want[1]) == 2
    monkeypatch.setattr(pii, "HELD", 12)
    believed = learn(docs)
    assert believed.count() > 12
    assert (texts(detect(docs, believed)), texts(redact(docs, believed))) == want


def test_memo_of_words_is_bounded():
    """A worker keeps some 60 MB of words, however many one text has, and keys are those of the words."""
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(300_000)] + ["end:"]
    assert pii._keys(words) == [pii.word_key(w) for w in words]
    assert len(pii._memo) <= 1 << 17
    pii._memo.clear()
