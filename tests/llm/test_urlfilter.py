"""The URL filter: odd URLs, rules, wildcards, merged branches and rejected templates."""

import duckdb
import pytest

from quillspark.llm.queries import URL_RULES
from quillspark.llm.urlfilter import judge_urls, oracle

SCHEMA = "page_id long, url string, template string, purity string"


def judged(spark, urls, rules=URL_RULES, labels=None):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], SCHEMA)
    if labels is not None:
        labels = spark.createDataFrame(labels, "page_id long, good int")
    return sorted(judge_urls(df, rules, labels).collect(), key=lambda r: r["page_id"])


def test_odd_urls(spark):
    long = "http://h.org/" + "a/" * 300 + "x" * 100_000
    urls = [None, "", "no scheme", "HTTP://A.Example.COM", "x://", "x://?q", "x://h#f", "x://H.org/P?q#f", "a://b://c/d", "x:///en/", "x://net/es/1", "x://anet/es/1", "x://www.example.com/en/", "x://É.net/es/", long, long]
    got = judged(spark, urls)
    host_path = [(r["host"], r["path"]) for r in got]
    assert host_path[:10] == [("", ""), ("", ""), ("", ""), ("a.example.com", ""), ("", ""), ("", ""), ("h", ""), ("h.org", "/P"), ("b:", "//c/d"), ("", "/en/")]
    assert [r["rule"] for r in got[10:14]] == ["net/es/", None, "www.example.com/en/", "net/es/"]
    assert got[13]["host"] == "É.net" and got[14]["path"] == long[12:] and got[14]["template"] == got[15]["template"]
    assert len(got) == len(urls)


def test_longest_rule_wins(spark):
    got = judged(spark, ["x://a.example.com/en/1", "x://a.example.com/fr/1", "x://b.www.example.com/en/1", "x://a.net/fr/"])
    assert [(r["rule"], r["verdict"]) for r in got] == [("example.com/en/", "block"), ("com/", "allow"), ("www.example.com/en/", "allow"), ("net/fr/", "block")]


def test_templates_without_a_rule_are_rejected_by_purity(spark):
    urls = [f"x://h.net/es/{k}" for k in range(30)] + [f"x://g.com/de/{k}" for k in range(30)] + ["x://h.net/en/5", "x://h.net/en/6", "x://g.org/en/5"]
    got = judged(spark, urls)
    assert [(r["verdict"], r["rule"], r["template"]) for r in got[60:]] == [("block", None, "/en/<n>"), ("block", None, "/en/<n>"), ("allow", None, "/en/<n>")]
    assert got[60]["purity"] < 0.1 < 0.5 <= got[62]["purity"]


def test_wildcards(spark):
    urls = [f"x://h/user/{name}/post" for name in ("ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ida")] + ["x://h/about/us"]
    bad = [(k, 0) for k in range(8)] + [(9, 1)]
    got = judged(spark, urls, [], bad)
    assert {r["template"] for r in got[:9]} == {"/user/*/post"} and got[9]["template"] == "/about/us"
    # the last has no label of its own, the wildcard's reject it
    assert got[8]["verdict"] == "block" and got[9]["verdict"] == "allow"


def test_similar_branches_merge(spark):
    urls = [f"x://h/{lang}/{k}" for lang in ("en", "fr", "de") for k in range(20)]
    labels = [(k, 0 if k < 40 else 1) for k in range(60)]
    got = judged(spark, urls, [], labels)
    assert {r["template"] for r in got[:40]} == {"/~0/<n>"} and {r["template"] for r in got[40:]} == {"/de/<n>"}
    assert {r["verdict"] for r in got[:40]} == {"block"} and {r["verdict"] for r in got[40:]} == {"allow"}


def test_deep_paths_differ_to_their_end(spark):
    deep = "x://h/a/b/c/d/e/f/g/h/i/"
    urls = [f"{deep}good"] * 10 + [f"{deep}bad"] * 10
    got = judged(spark, urls, [], [(k, int(k < 10)) for k in range(20)])
    assert [r["verdict"] for r in got] == ["allow"] * 10 + ["block"] * 10


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert judge_urls(none, URL_RULES).count() == 0
    rows = spark.createDataFrame([(None, "x://a.net/es/1", None, None), (None, "x://a.net/es/1", None, None), (1, None, None, None)], SCHEMA)
    assert sorted((r["page_id"] is None, r["verdict"]) for r in judge_urls(rows, URL_RULES).collect()) == [(False, "allow"), (True, "block"), (True, "block")]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    got = sorted(tuple(r) for r in judge_urls(pages, URL_RULES).fillna("").collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '/root/testdata/{folder}/pages.parquet'")
    want = con.execute(f"select page_id, host, path, coalesce(rule, ''), verdict, template, purity from ({oracle(URL_RULES)})").fetchall()
    assert got == sorted(want) and any(r[3] == "" and r[4] == "block" for r in got)
