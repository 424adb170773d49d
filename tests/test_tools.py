"""Edge fixtures of the star operators, plan shapes, ingestion and the harness."""

import pytest
from pyspark.sql import functions as F

from quillspark import harness
from quillspark.operators import Agg, Dimension, Join, StarQuery, membership_count, report, star_aggregate
from quillspark.plans import metrics, shapes
from quillspark.sources import ingest, parse_schemas, synthetic_star, table_sources, validate, write_parquet

FOLDER = "/root/testdata/sf0.001"


def test_synthetic_star(spark):
    for edge, want in ((False, 720), (True, 60)):
        t = synthetic_star(spark, 33_554_432 if not edge else 1_000_003, edge)
        dims = [("time_sk", t["times"].filter("t_hour = 20 and t_minute >= 30"), "t_time_sk"), ("demo_sk", t["demos"].filter("hd_dep_count = 7"), "hd_demo_sk"), ("store_sk", t["stores"].filter("s_store_name = 'ese'"), "s_store_sk")]
        got = membership_count(t["fact"], [Join(k, Dimension(d, key)) for k, d, key in dims]).first()[0]
        plain = t["fact"]
        for k, d, key in dims:
            plain = plain.join(d, plain[k] == d[key])
        assert got == plain.count() == want


def test_null_and_duplicate_keys(spark):
    fact = spark.createDataFrame([(1, 5), (2, 7), (None, 9), (4, 1)], "k int, v int")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "n")], "key int, name string")
    q = StarQuery(fact, (Join("k", Dimension(dim, "key", ("name",))),), (Agg("sum", "v", "s"), Agg("count", None, "n")), ("name",))
    assert sorted(map(tuple, star_aggregate(q).collect())) == [("a", 12, 2), ("b", 5, 1)]
    assert membership_count(fact, [Join("k", Dimension(dim, "key"))]).first()[0] == 3
    assert report([Dimension(dim, "key", ("name",))]).reason == "duplicate key with attributes"
    assert report([Dimension(dim.filter("false"), "key", ("name",))]).reason == "empty dimension"
    assert report([Dimension(dim.withColumn("x", F.lit(1.0)), "key", ("x",))]).reason.startswith("unsupported type")


def test_shapes(spark):
    star = "FROM lineitem JOIN part ON l_partkey = p_partkey"
    got = {r.name: r for r in shapes(spark, FOLDER, {
        "grouped": f"SELECT p_brand, sum(l_linenumber) {star} GROUP BY p_brand",
        "distinct": f"SELECT p_brand, count(DISTINCT l_suppkey) {star} GROUP BY p_brand",
        "rollup": f"SELECT p_brand, p_size, sum(l_linenumber) {star} GROUP BY ROLLUP (p_brand, p_size)",
        "fact key": f"SELECT l_returnflag, count(*) {star} GROUP BY l_returnflag",
        "filter": f"SELECT p_brand, count(*) {star} WHERE l_quantity > 3 GROUP BY p_brand",
        "minmax": f"SELECT p_brand, max(l_linenumber) {star} GROUP BY p_brand",
        "theta": f"SELECT l_orderkey {star} AND l_linenumber < p_size",
        "broken": "SELECT nothing FROM nowhere",
    }).collect()}
    assert got["grouped"].shape == "grouped_aggregate" and got["grouped"].joins == 1
    assert not got["distinct"].eligible and got["distinct"].reason
    assert got["rollup"].reason == "Expand below the aggregate"
    assert got["fact key"].reason == "group key on the fact side"
    assert got["filter"].reason == "filter beyond IsNotNull"
    assert got["minmax"].reason == "unsupported function max"
    assert got["theta"].reason == "residual join condition"
    assert got["broken"].reason.startswith("unreadable query")


def test_limits_of_shapes(spark):
    star = "FROM lineitem JOIN part ON l_partkey = p_partkey"
    one = f"SELECT p_brand, sum(l_linenumber) s {star} GROUP BY p_brand"
    asked = {
        "two": f"{one} UNION ALL {one.replace('p_brand', 'p_type')}",
        "not null": f"SELECT p_brand, count(*) {star} WHERE l_tax IS NOT NULL GROUP BY p_brand",
        "double": f"SELECT p_brand, sum(l_tax) {star} GROUP BY p_brand",
        "dimension": f"SELECT p_brand, sum(p_size) {star} GROUP BY p_brand",
        "computed": f"SELECT p_brand, sum(l_linenumber + 1) {star} GROUP BY p_brand",
        "attribute": f"SELECT l_linenumber, p_retailprice {star}",
        "one key": f"SELECT count(*) {star}",
        "join": f"SELECT l_linenumber, p_brand {star}",
        "wide": f"SELECT l_orderkey, p_brand {star}",
        "fused": "SELECT sum(CASE WHEN l_linenumber > 3 THEN l_linenumber * 3 + 7 ELSE 0 END) FROM lineitem",
        "not fused": "SELECT sum(CASE WHEN l_linenumber > 3 THEN l_linenumber * 3 + 7 ELSE 1 END) FROM lineitem",
    }
    got = {r.name: (r.shape, r.reason) for r in shapes(spark, FOLDER, asked).collect()}
    assert got["two"] == ("", "2 regions, more than 1")
    assert shapes(spark, FOLDER, {"two": asked["two"]}, 0).first().shape == "grouped_aggregate"
    assert got["not null"][1] == "IsNotNull on l_tax, which is no join key"
    assert got["double"][1] == "measure is not INT32 but double"
    assert got["dimension"][1] == "measure on the dimension side"
    assert got["computed"][1] in ("measure is not a bare column", "computed projection")
    assert got["attribute"][1] == "unsupported attribute type double"
    assert got["one key"][1].startswith("count without group keys")
    assert got["join"][0] == "star_join" and got["wide"][1].startswith("fact output")
    assert got["fused"][0] == "fused_sum" and got["not fused"][1] == "no join"


def test_tools_of_the_command_line(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "q2.sql").write_text("SELECT count(*) AS n FROM nation;\n")
    (tmp_path / "sql" / "q10.sql").write_text("SELECT p_brand, sum(l_linenumber) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
    for leg in ("a", "b"):
        done = harness.run_files(spark, FOLDER, str(tmp_path / "sql"), str(tmp_path / leg), runs=1, warm_ups=0, label=leg)
        assert list(done["queries"]) == ["q2", "q10"] and done["environment"]["spark"] == spark.version
        assert (tmp_path / leg / "q10-plan.txt").read_text()
    both = harness.compare_files(str(tmp_path / "a" / "summary.json"), str(tmp_path / "b" / "summary.json"), 0.0)
    assert both["match"] and both["gate"] and both["other"] == "b"
    parts = harness.phases(spark, (tmp_path / "sql" / "q10.sql").read_text())
    assert all(parts[k] > 0 for k in ("planning_cold", "planning_warm", "split_enumeration", "dimension_collect", "scan", "end_to_end"))
    harness.generate(spark, "sum", str(tmp_path / "sum"), 5000)
    assert harness.benchmark(spark, "sum", str(tmp_path / "sum"), 0, 1)["result"] > 0
    harness.generate(spark, "star-edge", str(tmp_path / "star"), 1_000_003)
    assert harness.benchmark(spark, "star-edge", str(tmp_path / "star"), 0, 1, 60)["result"] == 60
    with pytest.raises(RuntimeError):
        harness.benchmark(spark, "star-edge", str(tmp_path / "star"), 0, 1, 61)
    assert validate(spark, str(tmp_path / "star"), {"stores": 101, "none": 1})[0]["ok"]
    (tmp_path / "star" / "stores" / "_SUCCESS").unlink()
    assert [r["reason"] for r in validate(spark, str(tmp_path / "star"), {"stores": 101, "none": 1, "demos": 9})] == ["no _SUCCESS", "no such table", "other number of rows"]


def test_ingestion(spark, tmp_path):
    schemas = parse_schemas("create table t (a integer not null, b decimal(7,2), c char(3), d date, primary key (a));\ncreate table t_more (a integer);")
    assert schemas["t"].simpleString() == "struct<a:int,b:decimal(7,2),c:string,d:date>"
    with pytest.raises(ValueError):
        parse_schemas("create table t (a blob);")
    (tmp_path / "t_1_2.dat").write_text("1|2.50|x|2020-01-02|\n")
    (tmp_path / "t_2_2.dat").write_text("2|||\n")
    (tmp_path / "t_more.dat").write_text("9|\n")
    files = table_sources(spark, str(tmp_path), "t")
    assert len(files) == 2
    df = ingest(spark, files, schemas["t"])
    assert df.filter("a = 2").first()[1:] == (None, None, None)
    write_parquet(df, str(tmp_path / "t.parquet"))
    assert validate(spark, str(tmp_path), {"t": 2})[0]["ok"]
    with pytest.raises(Exception, match="(?i)exists"):
        write_parquet(df, str(tmp_path / "t.parquet"))


def test_harness(spark):
    a = harness.run(lambda: spark.range(5), 0, 2)
    assert a["rows"] == 5 and harness.compare(a, a)["match"]
    assert harness.natural(["q10", "q2"]) == ["q2", "q10"]
    with pytest.raises(KeyError):
        harness.chosen(["q1"], "q9")
    df = spark.range(10).groupBy().count()
    df.collect()
    assert metrics(df)
