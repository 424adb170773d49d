"""The registered queries of the star-schema operators, with the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import Agg, Dimension, Join, StarQuery, decode, encode, fused_sum, membership_count, star_aggregate, star_join
from quillspark.plans import shapes
from quillspark.sources import footer_report, ingest, split_inventory, write_parquet
from quillspark.streaming import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _dims(spark: SparkSession, folder: str, unique: bool = True) -> list[Join]:
    part = _t(spark, folder, "part").filter("p_size < 10")
    supplier = _t(spark, folder, "supplier").filter("s_nationkey < 12")
    orders = _t(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    return [Join("l_partkey", Dimension(part, "p_partkey", unique=unique)), Join("l_suppkey", Dimension(supplier, "s_suppkey", unique=unique)), Join("l_orderkey", Dimension(orders, "o_orderkey", unique=unique))]


def _part(spark: SparkSession, folder: str, *attrs: str, where: str = "p_size < 10") -> Join:
    return Join("l_partkey", Dimension(_t(spark, folder, "part").filter(where), "p_partkey", attrs))


def _supplier(spark: SparkSession, folder: str, *attrs: str, where: str = "s_nationkey < 12") -> Join:
    return Join("l_suppkey", Dimension(_t(spark, folder, "supplier").filter(where), "s_suppkey", attrs))


_STAR = "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
_STAR3 = f"{_STAR} JOIN orders ON l_orderkey = o_orderkey"
_WHERE = "p_size < 10 AND s_nationkey < 12"
_URGENT = "o_orderpriority = '1-URGENT'"


# --- fused sum -------------------------------------------------------------


@query("SELECT CAST(sum(CASE WHEN l_linenumber > 3 THEN l_linenumber * 3 + 7 ELSE 0 END) AS BIGINT) AS total FROM lineitem")
def fused_sum_plain(spark, folder):
    return fused_sum(_t(spark, folder, "lineitem"), "l_linenumber", 3, 3, 7)


@query("SELECT CAST(sum(CASE WHEN v > 3 THEN v * 3 + 7 ELSE 0 END) AS BIGINT) AS total FROM (SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_linenumber END AS v FROM lineitem)")
def fused_sum_nullable(spark, folder):
    df = _t(spark, folder, "lineitem").select(F.expr("if(l_orderkey % 17 = 0, null, l_linenumber)").alias("v"))
    return fused_sum(df, "v", 3, 3, 7)


@query("SELECT CAST(sum(CASE WHEN l_linenumber > 3 THEN (((x + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648 ELSE 0 END) AS BIGINT) AS total FROM (SELECT l_linenumber, CAST(l_linenumber AS BIGINT) * 1000000007 + 7 AS x FROM lineitem)")
def fused_sum_wrap32(spark, folder):
    return fused_sum(_t(spark, folder, "lineitem"), "l_linenumber", 3, 1000000007, 7, wrap=True)


# --- membership counts ------------------------------------------------------


@query(f"SELECT count(*) AS n FROM {_STAR3} WHERE {_WHERE} AND {_URGENT}")
def membership_count3(spark, folder):
    return membership_count(_t(spark, folder, "lineitem"), _dims(spark, folder))


def _twice(table: str, condition: str, other: str) -> str:
    return f"(SELECT * FROM {table} WHERE {condition} UNION ALL SELECT * FROM {table} WHERE {other})"


@query(f"SELECT count(*) AS n FROM lineitem JOIN {_twice('part', 'p_size < 20', 'p_size < 10')} ON l_partkey = p_partkey JOIN {_twice('supplier', 's_nationkey < 12', 's_nationkey < 5')} ON l_suppkey = s_suppkey JOIN {_twice('orders', _URGENT, 'true')} ON l_orderkey = o_orderkey")
def membership_dup(spark, folder):
    part, supplier, orders = (_t(spark, folder, n) for n in ("part", "supplier", "orders"))
    return membership_count(_t(spark, folder, "lineitem"), [Join("l_partkey", Dimension(part.filter("p_size < 20").union(part.filter("p_size < 10")), "p_partkey")), Join("l_suppkey", Dimension(supplier.filter("s_nationkey < 12").union(supplier.filter("s_nationkey < 5")), "s_suppkey")), Join("l_orderkey", Dimension(orders.filter(_URGENT).union(orders), "o_orderkey"))])


@query(f"SELECT count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_partkey END AS k, * FROM lineitem) JOIN part ON k = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE {_WHERE} AND {_URGENT}")
def membership_null_key(spark, folder):
    fact = _t(spark, folder, "lineitem").withColumn("l_partkey", F.expr("if(l_orderkey % 17 = 0, null, l_partkey)"))
    return membership_count(fact, _dims(spark, folder, unique=False))


@query("SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 1000")
def membership_empty(spark, folder):
    return membership_count(_t(spark, folder, "lineitem"), [_part(spark, folder, where="p_size > 1000")])


@query("SELECT count(*) FILTER (WHERE p_size < 10) AS n1, count(*) FILTER (WHERE p_size BETWEEN 10 AND 19) AS n2, count(*) FILTER (WHERE p_size >= 20) AS n3 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 12")
def membership_multi_branch(spark, folder):
    # one scan and one join serve all branches
    aggs = [Agg("count", None, "n1", F.expr("p_size < 10")), Agg("count", None, "n2", F.expr("p_size between 10 and 19")), Agg("count", None, "n3", F.expr("p_size >= 20"))]
    return star_aggregate(StarQuery(_t(spark, folder, "lineitem"), (_part(spark, folder, "p_size", where="true"), _supplier(spark, folder)), tuple(aggs)))


@query(f"SELECT round(CAST(count(*) FILTER (WHERE p_size < 10) AS DOUBLE) / CAST(count(*) FILTER (WHERE p_size >= 10) AS DOUBLE), 10) AS ratio FROM {_STAR} WHERE s_nationkey < 12")
def membership_ratio(spark, folder):
    aggs = (Agg("count", None, "a", F.expr("p_size < 10")), Agg("count", None, "b", F.expr("p_size >= 10")))
    return star_aggregate(StarQuery(_t(spark, folder, "lineitem"), (_part(spark, folder, "p_size", where="true"), _supplier(spark, folder)), aggs)).select(F.round(F.col("a").cast("double") / F.nullif(F.col("b").cast("double"), F.lit(0.0)), 10).alias("ratio"))


# --- grouped aggregates -----------------------------------------------------

_LINE = "CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_linenumber) AS c, count(*) AS n"
_BASE = (Agg("sum", "l_linenumber", "s"), Agg("count", "l_linenumber", "c"), Agg("count", None, "n"))


def _group(spark, folder, group_by, aggs=_BASE, fact=None, part=None, supplier=("s_nationkey",), **more):
    joins = (part or _part(spark, folder, "p_brand"), _supplier(spark, folder, *supplier))
    return star_aggregate(StarQuery(fact if fact is not None else _t(spark, folder, "lineitem"), joins, tuple(aggs), tuple(group_by), **more))


@query(f"SELECT p_brand, s_nationkey, {_LINE}, avg(l_linenumber) AS a FROM {_STAR} WHERE {_WHERE} GROUP BY ALL")
def star_group_sum_count_avg(spark, folder):
    return _group(spark, folder, ["p_brand", "s_nationkey"], (*_BASE, Agg("avg", "l_linenumber", "a")))


@query(f"SELECT p_brand, CAST(sum(q) AS DECIMAL(17,2)) AS s, CAST(round(sum(q) / count(q), 6) AS DECIMAL(11,6)) AS a FROM (SELECT p_brand, CAST(l_quantity AS DECIMAL(7,2)) AS q FROM {_STAR} WHERE {_WHERE}) GROUP BY p_brand")
def star_group_decimal(spark, folder):
    q = F.col("l_quantity").cast("decimal(7,2)")
    return _group(spark, folder, ["p_brand"], (Agg("sum", q, "s"), Agg("avg", q, "a")), supplier=())


@query(f"SELECT p_brand, CAST(sum(v) AS BIGINT) AS s, avg(v) AS a, count(v) AS c FROM (SELECT p_brand, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE l_linenumber END AS v FROM {_STAR} WHERE {_WHERE}) GROUP BY p_brand")
def star_group_null_measure(spark, folder):
    v = F.expr("if(p_brand = 'Brand#1', null, l_linenumber)")
    return _group(spark, folder, ["p_brand"], (Agg("sum", v, "s"), Agg("avg", v, "a"), Agg("count", v, "c")), supplier=())


@query(f"SELECT brand, {_LINE} FROM (SELECT *, CASE WHEN p_size < 5 THEN NULL ELSE p_brand END AS brand FROM part WHERE p_size < 10) JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 12 GROUP BY brand")
def star_group_null_attr(spark, folder):
    part = _t(spark, folder, "part").filter("p_size < 10").withColumn("brand", F.expr("if(p_size < 5, null, p_brand)"))
    return _group(spark, folder, ["brand"], part=Join("l_partkey", Dimension(part, "p_partkey", ("brand",))), supplier=())


@query(f"SELECT CAST(o_orderdate AS DATE) AS d, CAST(p_retailprice AS DECIMAL(7,2)) AS price, {_LINE} FROM {_STAR3} WHERE p_size < 3 AND {_URGENT} GROUP BY ALL")
def star_group_date_key(spark, folder):
    orders = _t(spark, folder, "orders").filter(_URGENT).select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    part = _t(spark, folder, "part").filter("p_size < 3").select("p_partkey", F.col("p_retailprice").cast("decimal(7,2)").alias("price"))
    joins = (Join("l_partkey", Dimension(part, "p_partkey", ("price",))), Join("l_orderkey", Dimension(orders, "o_orderkey", ("d",))))
    return star_aggregate(StarQuery(_t(spark, folder, "lineitem"), joins, _BASE, ("d", "price")))


@query(f"SELECT label, {_LINE} FROM lineitem JOIN (SELECT p_partkey, p_brand AS label FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size < 5) ON l_partkey = p_partkey GROUP BY label")
def star_group_fanout(spark, folder):
    part = _t(spark, folder, "part")
    both = part.filter("p_size < 10").select("p_partkey", F.col("p_brand").alias("label")).union(part.filter("p_size < 5").select("p_partkey", "p_type"))
    return star_aggregate(StarQuery(_t(spark, folder, "lineitem"), (Join("l_partkey", Dimension(both, "p_partkey", ("label",))),), _BASE, ("label",)))


@query(f"SELECT {_LINE}, avg(l_linenumber) AS a FROM {_STAR} WHERE {_WHERE}")
def star_global_sum(spark, folder):
    return _group(spark, folder, [], (*_BASE, Agg("avg", "l_linenumber", "a")), supplier=())


@query(f"SELECT {_LINE} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 1000")
def star_global_sum_empty(spark, folder):
    return star_aggregate(StarQuery(_t(spark, folder, "lineitem"), (_part(spark, folder, where="p_size > 1000"),), _BASE))


@query(f"SELECT p_brand, {_LINE}, count(*) FILTER (WHERE l_linenumber > 3) AS f FROM {_STAR} WHERE {_WHERE} AND l_returnflag = 'R' GROUP BY p_brand")
def star_group_filtered(spark, folder):
    return _group(spark, folder, ["p_brand"], (*_BASE, Agg("count", None, "f", F.expr("l_linenumber > 3"))), supplier=(), where=F.expr("l_returnflag = 'R'"))


@query(f"SELECT p_brand, count(DISTINCT l_suppkey) AS d FROM {_STAR} WHERE {_WHERE} GROUP BY p_brand")
def star_group_distinct(spark, folder):
    return _group(spark, folder, ["p_brand"], (Agg("count_distinct", "l_suppkey", "d"),), supplier=())


@query(f"SELECT p_brand, min(l_linenumber) AS lo, max(l_shipdate) AS hi FROM {_STAR} WHERE {_WHERE} GROUP BY p_brand")
def star_group_minmax(spark, folder):
    return _group(spark, folder, ["p_brand"], (Agg("min", "l_linenumber", "lo"), Agg("max", "l_shipdate", "hi")), supplier=())


@query(f"SELECT p_brand, s_nationkey, CAST(grouping_id(p_brand, s_nationkey) AS BIGINT) AS g, {_LINE} FROM {_STAR} WHERE {_WHERE} GROUP BY ROLLUP (p_brand, s_nationkey)")
def star_rollup(spark, folder):
    return _group(spark, folder, ["p_brand", "s_nationkey"], grouping="rollup", extra=(F.grouping_id().cast("bigint").alias("g"),))


@query(f"SELECT p_brand, s_nationkey, CAST(grouping_id(p_brand, s_nationkey) AS BIGINT) AS g, {_LINE} FROM {_STAR} WHERE {_WHERE} GROUP BY CUBE (p_brand, s_nationkey)")
def star_cube(spark, folder):
    return _group(spark, folder, ["p_brand", "s_nationkey"], grouping="cube", extra=(F.grouping_id().cast("bigint").alias("g"),))


@query(f"SELECT p_brand, s_nationkey, {_LINE} FROM {_STAR} WHERE {_WHERE} GROUP BY GROUPING SETS ((p_brand), (s_nationkey))")
def star_grouping_sets(spark, folder):
    rows = star_join(_t(spark, folder, "lineitem"), [_part(spark, folder, "p_brand"), _supplier(spark, folder, "s_nationkey")], ["p_brand", "s_nationkey", "l_linenumber"])
    return rows.groupingSets([["p_brand"], ["s_nationkey"]], "p_brand", "s_nationkey").agg(*(a.build() for a in _BASE))


# --- joins ------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, p_brand, s_nationkey FROM {_STAR} WHERE {_WHERE}")
def star_join_project(spark, folder):
    return star_join(_t(spark, folder, "lineitem"), [_part(spark, folder, "p_brand"), _supplier(spark, folder, "s_nationkey")], ["l_orderkey", "l_linenumber", "p_brand", "s_nationkey"])


@query("SELECT l_orderkey, l_linenumber, label FROM lineitem JOIN (SELECT p_partkey, p_brand AS label FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size < 5) ON l_partkey = p_partkey")
def star_join_fanout(spark, folder):
    part = _t(spark, folder, "part")
    both = part.filter("p_size < 10").select("p_partkey", F.col("p_brand").alias("label")).union(part.filter("p_size < 5").select("p_partkey", "p_type"))
    return star_join(_t(spark, folder, "lineitem"), [Join("l_partkey", Dimension(both, "p_partkey", ("label",)))], ["l_orderkey", "l_linenumber", "label"])


@query("SELECT l_partkey, p_partkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def star_join_selfkey(spark, folder):
    return star_join(_t(spark, folder, "lineitem"), [_part(spark, folder)], ["l_partkey", "p_partkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def star_join_semi(spark, folder):
    return star_join(_t(spark, folder, "lineitem"), [_part(spark, folder)], ["l_orderkey", "l_linenumber", "l_partkey"], "left_semi")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size < 10 AND p_partkey = l_partkey)")
def star_join_anti(spark, folder):
    return star_join(_t(spark, folder, "lineitem"), [_part(spark, folder)], ["l_orderkey", "l_linenumber", "l_partkey"], "left_anti")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON l_partkey = p_partkey")
def star_join_left(spark, folder):
    return star_join(_t(spark, folder, "lineitem"), [_part(spark, folder, "p_brand")], ["l_orderkey", "l_linenumber", "p_brand"], "left")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey AND l_linenumber < p_size WHERE p_size < 10")
def star_join_theta(spark, folder):
    return _t(spark, folder, "lineitem").join(_t(spark, folder, "part").filter("p_size < 10"), F.expr("l_partkey = p_partkey AND l_linenumber < p_size")).select("l_orderkey", "l_linenumber", "p_brand")


# --- around star regions ----------------------------------------------------


@query(f"SELECT p_brand, s_nationkey, s, round(avg(s) OVER (PARTITION BY p_brand), 6) AS mean FROM (SELECT p_brand, s_nationkey, CAST(sum(l_linenumber) AS BIGINT) AS s FROM {_STAR} WHERE {_WHERE} GROUP BY ALL)")
def window_over_group(spark, folder):
    rows = _group(spark, folder, ["p_brand", "s_nationkey"], (Agg("sum", "l_linenumber", "s"),))
    return rows.withColumn("mean", F.round(F.avg("s").over(Window.partitionBy("p_brand")), 6))


@query(f"SELECT p_brand, s_nationkey, {_LINE} FROM {_STAR} WHERE {_WHERE} GROUP BY ALL ORDER BY s DESC, p_brand, s_nationkey LIMIT 10")
def topk_over_group(spark, folder):
    return _group(spark, folder, ["p_brand", "s_nationkey"]).orderBy(F.desc("s"), "p_brand", "s_nationkey").limit(10)


def _brand(spark, folder, where, key):
    part = _part(spark, folder, "p_brand", where=where)
    return star_aggregate(StarQuery(_t(spark, folder, "lineitem"), (part,), (Agg("sum", "l_linenumber", "s"),), ("p_brand",))).withColumn("region", F.lit(key))


_BRAND = "SELECT p_brand, CAST(sum(l_linenumber) AS BIGINT) AS s, '{key}' AS region FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where} GROUP BY p_brand"
_NAMES = "SELECT DISTINCT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where}"


@query(_BRAND.format(key="small", where="p_size < 10") + " UNION ALL " + _BRAND.format(key="large", where="p_size > 40"))
def union_regions(spark, folder):
    return _brand(spark, folder, "p_size < 10", "small").unionByName(_brand(spark, folder, "p_size > 40", "large"))


@query(_NAMES.format(where="p_size = 1") + " INTERSECT " + _NAMES.format(where="p_size = 2"))
def intersect_regions(spark, folder):
    return _brand(spark, folder, "p_size = 1", "a").select("p_brand").intersect(_brand(spark, folder, "p_size = 2", "b").select("p_brand"))


@query(_NAMES.format(where="p_size < 10") + " EXCEPT " + _NAMES.format(where="p_size = 1"))
def except_regions(spark, folder):
    return _brand(spark, folder, "p_size < 10", "a").select("p_brand").subtract(_brand(spark, folder, "p_size = 1", "b").select("p_brand"))


@query(f"WITH g AS (SELECT p_brand, CAST(sum(l_linenumber) AS BIGINT) AS s FROM {_STAR} WHERE {_WHERE} GROUP BY p_brand) SELECT p_brand, s FROM g WHERE s > (SELECT avg(s) FROM g)")
def scalar_subquery_region(spark, folder):
    rows = _group(spark, folder, ["p_brand"], (Agg("sum", "l_linenumber", "s"),), supplier=())
    return rows.join(rows.agg(F.avg("s").alias("mean")), F.col("s") > F.col("mean")).select("p_brand", "s")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, folder):
    return windowed(_t(spark, folder, "events"), "ts", "1 hour", [Agg("count", None, "n"), Agg("sum", "value", "total")], ["event_type"]).withColumn("total", F.round("total", 4))


# --- group space, plans, footers, ingestion ---------------------------------


def _space(spark, folder):
    return [_part(spark, folder, "p_brand").dimension, _supplier(spark, folder, "s_nationkey").dimension]


_CODES = f"SELECT p_brand, s_nationkey, CAST(a.c + b.c * (SELECT count(DISTINCT p_brand) FROM part WHERE p_size < 10) AS BIGINT) AS group_id FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS c FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 10)) a CROSS JOIN (SELECT s_nationkey, row_number() OVER (ORDER BY s_nationkey) - 1 AS c FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey < 12)) b"


@query(_CODES)
def group_space_encode(spark, folder):
    return encode(_space(spark, folder))


@query(f"SELECT group_id, p_brand, s_nationkey FROM ({_CODES})")
def group_space_decode(spark, folder):
    dims = _space(spark, folder)
    return decode(encode(dims).select("group_id"), dims)


#: What each statement is to be classified as: shape, reason of refusal, joins, regions.
_SHAPES = {
    "fused_sum_plain": ("fused_sum", "", 0, 1),
    "fused_sum_nullable": ("fused_sum", "", 0, 1),
    "membership_count3": ("membership_scan", "", 3, 1),
    "membership_null_key": ("", "filter beyond IsNotNull", 0, 0),
    "membership_ratio": ("", "distinct or filtered aggregate", 0, 0),
    "star_group_sum_count_avg": ("grouped_aggregate", "", 2, 1),
    "star_group_decimal": ("", "computed projection", 0, 0),
    "star_group_fanout": ("grouped_aggregate", "", 1, 1),
    "star_global_sum": ("global_aggregate", "", 2, 1),
    "star_group_distinct": ("", "distinct or filtered aggregate", 0, 0),
    "star_group_minmax": ("", "unsupported function min", 0, 0),
    "star_rollup": ("", "Expand below the aggregate", 0, 0),
    "star_cube": ("", "Expand below the aggregate", 0, 0),
    "star_grouping_sets": ("", "Expand below the aggregate", 0, 0),
    "star_join_project": ("", "fact output is not INT32-backed but bigint", 0, 0),
    "star_join_left": ("", "non-inner join", 0, 0),
    "star_join_theta": ("", "residual join condition", 0, 0),
    "window_over_group": ("grouped_aggregate", "", 2, 1),
    "topk_over_group": ("grouped_aggregate", "", 2, 1),
    "union_regions": ("", "2 regions, more than 1", 0, 2),
    "ingest_roundtrip": ("", "no join at the top but Scan", 0, 0),
}
_EXPECTED = ", ".join(f"('{k}', '{s}', {str(bool(s)).lower()}, '{r}', {j}, {n})" for k, (s, r, j, n) in _SHAPES.items())


@query(f"SELECT * FROM (VALUES {_EXPECTED}) AS t(name, shape, eligible, reason, joins, regions)")
def plan_shapes(spark, folder):
    return shapes(spark, folder, {k: ORACLE_SQL[k] for k in _SHAPES})


@query()
def footer_eligibility(spark, folder):
    return footer_report(spark, f"{folder}/lineitem.parquet", ["l_linenumber", "l_partkey", "l_quantity"], plain_allowed=True)


@query()
def split_listing(spark, folder):
    return split_inventory(spark, f"{folder}/lineitem.parquet")


@query("SELECT p_partkey, p_brand, p_size FROM part")
def ingest_roundtrip(spark, folder):
    """Pipe-delimited text written and read back under a declared schema, then through Parquet."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    at = f"{top.rstrip('/')}/ingest-{uuid.uuid4().hex}"
    part = _t(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    part.write.option("sep", "|").csv(f"{at}/text")
    write_parquet(ingest(spark, [f"{at}/text"], part.schema), f"{at}/parquet", "zstd")
    return spark.read.parquet(f"{at}/parquet")
