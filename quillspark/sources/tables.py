"""Registration of Parquet tables and typed ingestion of pipe-delimited files."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The tables of a data folder.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CODECS = ("snappy", "uncompressed", "zstd")

#: The column types that table definitions may have; char and varchar are strings.
KINDS = (T.IntegerType, T.DateType, T.DecimalType, T.CharType, T.VarcharType, T.StringType)


def _listed(spark: SparkSession, folder: str) -> list:
    """The status of every file and folder in ``folder``, by any file system that Spark reads."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return list(top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top))


def tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name and path of each table of a folder: its sub-folders, and single Parquet files."""
    out = {}
    for f in _listed(spark, folder):
        name = f.getPath().getName()
        if not name.startswith(("_", ".")) and (f.isDirectory() or name.endswith(".parquet")):
            out[name.removesuffix(".parquet")] = f.getPath().toString()
    return dict(sorted(out.items()))


def register(spark: SparkSession, folder: str, names: tuple[str, ...] | None = None) -> list[str]:
    """Makes each table of ``folder``, or those of ``names``, a temporary view of its name."""
    found = tables(spark, folder)
    if missing := set(names or ()) - set(found):
        raise FileNotFoundError(f"no table {', '.join(sorted(missing))} in {folder}")
    for name in names or found:
        spark.read.parquet(found[name]).createOrReplaceTempView(name)
    return list(names or found)


def parse_schemas(ddl: str) -> dict[str, T.StructType]:
    """The schema of each CREATE TABLE of ``ddl``, its columns read by Spark's own parser.

    Every field may be null, whatever the definition says; primary keys are
    skipped; a time is kept as its text.  Needs a running session.
    """
    out = {}
    for statement in re.sub(r"--.*", "", ddl).split(";"):
        head, _, body = statement.partition("(")
        words = head.lower().split()
        if words[:2] != ["create", "table"] or len(words) != 3:
            continue
        body = body.rstrip().removesuffix(")")
        body = re.sub(r",?\s*primary\s+key\s*\([^)]*\)", "", body, flags=re.IGNORECASE)
        body = re.sub(r"(\w\s+)time\b", r"\1string", body, flags=re.IGNORECASE)
        try:
            declared = T.StructType.fromDDL(body)
        except ParseException as e:
            raise ValueError(f"table {words[2]}: {e}") from e
        if wrong := [f.name for f in declared if not isinstance(f.dataType, KINDS)]:
            raise ValueError(f"unsupported column type of {', '.join(wrong)} in table {words[2]}")
        text = (T.CharType, T.VarcharType)
        out[words[2]] = T.StructType([T.StructField(f.name.lower(), T.StringType() if isinstance(f.dataType, text) else f.dataType) for f in declared])
    return out


def table_sources(spark: SparkSession, folder: str, table: str) -> list[str]:
    """The files of a table, ``t.dat`` or chunks ``t_1_8.dat``, without those of tables it prefixes."""
    match = re.compile(rf"{re.escape(table)}(_\d+_\d+)?\.dat").fullmatch
    return sorted(f.getPath().toString() for f in _listed(spark, folder) if match(f.getPath().getName()))


def ingest(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Pipe-delimited files under a declared schema; an empty field is null."""
    if not files:
        raise FileNotFoundError("no source files")
    return spark.read.schema(schema).option("sep", "|").option("nullValue", "").option("dateFormat", "yyyy-MM-dd").csv(files)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Writes ``df``; a path that exists is refused."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is none of {CODECS}")
    df.write.mode("errorifexists").option("compression", codec).parquet(path)


def validate(spark: SparkSession, folder: str, expected: dict[str, int]) -> list[dict]:
    """Rows and schema of each table against the expected number of rows; a folder must hold its writer's ``_SUCCESS``."""
    out, found = [], tables(spark, folder)
    for name, rows in expected.items():
        if name not in found:
            out.append({"table": name, "rows": None, "expected": rows, "ok": False, "reason": "no such table", "schema": None})
            continue
        whole = found[name].endswith(".parquet") and _listed(spark, found[name])[0].getPath().toString() == found[name]
        whole = whole or any(f.getPath().getName() == "_SUCCESS" for f in _listed(spark, found[name]))
        df = spark.read.parquet(found[name])
        n = df.count()
        reason = "" if whole and n == rows else "no _SUCCESS" if not whole else "other number of rows"
        out.append({"table": name, "rows": n, "expected": rows, "ok": not reason, "reason": reason, "schema": df.schema.simpleString()})
    return out


#: The values of :func:`synthetic_values` repeat after this many rows.
CYCLE = 1009


def synthetic_values(spark: SparkSession, rows: int) -> DataFrame:
    """``value``: every whole number under ``CYCLE`` once in each ``CYCLE`` rows, out of order."""
    return spark.range(rows).selectExpr(f"cast(pmod(id * 31, {CYCLE}) as int) as value")


def synthetic_sum(rows: int, threshold: int, multiplier: int, addend: int) -> int:
    """What the fused sum of :func:`synthetic_values` is, by whole cycles and the rest."""
    one = lambda v: v * multiplier + addend if v > threshold else 0
    cycles, rest = divmod(rows, CYCLE)
    return cycles * sum(map(one, range(CYCLE))) + sum(one(k * 31 % CYCLE) for k in range(rest))


def synthetic_star(spark: SparkSession, rows: int, edge: bool = False) -> dict[str, DataFrame]:
    """A fact with three keys and its dimensions by fixed formulas; ``edge`` adds null and repeated keys."""
    # The formulas of the fixture, whose expected counts (720 and 60) hold for them alone
    time_key = "if(pmod(id, 97) = 0, null, cast(pmod(id, 1440) as int))" if edge else "cast(pmod(id, 1440) as int)"
    fact = spark.range(rows).selectExpr(f"{time_key} as time_sk", "cast(pmod(id div 1440, 1000) as int) as demo_sk", "cast(pmod(id div 14400, 100) as int) as store_sk")
    times = spark.range(1440).selectExpr("cast(id as int) as t_time_sk", "cast(id div 60 as int) as t_hour", "cast(pmod(id, 60) as int) as t_minute")
    demos = spark.range(1000).selectExpr("cast(id as int) as hd_demo_sk", "cast(pmod(id, 10) as int) as hd_dep_count")
    stores = spark.range(101 if edge else 100).selectExpr("cast(if(id = 100, 17, id) as int) as s_store_sk", "if(id in (17, 100), 'ese', concat('store-', id)) as s_store_name")
    return {"fact": fact, "times": times, "demos": demos, "stores": stores}
