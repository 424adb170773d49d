"""``python -m quillspark``: run, compare, phases, synthetic, environment, ingest, validate, shapes and footers."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from quillspark import harness, sources
from quillspark.plans import shapes
from quillspark.queries import QUERIES


def statements(given: list[str]) -> dict[str, str]:
    """Names and texts: a file has its own name, a statement its number."""
    return {Path(s).stem if s.endswith(".sql") else f"q{k + 1}": Path(s).read_text() if s.endswith(".sql") else s for k, s in enumerate(given)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("run")
    c.add_argument("--data-dir", required=True)
    c.add_argument("--queries-dir", help="a folder of *.sql; without it, the registered queries run")
    c.add_argument("--output-dir")
    c.add_argument("--label", default="spark")
    c.add_argument("--queries", default="all")
    c.add_argument("--warmups", type=int, default=1)
    c.add_argument("--runs", type=int, default=5)
    c = sub.add_parser("compare")
    c.add_argument("base", help="summary.json of one run")
    c.add_argument("other")
    c.add_argument("--gate", type=float, default=1.10)
    c.add_argument("--output")
    c = sub.add_parser("phases")
    c.add_argument("--data-dir", required=True)
    c.add_argument("--sql", required=True, nargs="+", help="statements, or files of them")
    c.add_argument("--output")
    c = sub.add_parser("synthetic")
    c.add_argument("action", choices=("generate", "run"))
    c.add_argument("kind", choices=("sum", "star", "star-edge"))
    c.add_argument("path")
    c.add_argument("--rows", type=int, default=1 << 25)
    c.add_argument("--expect", type=int)
    c.add_argument("--warmups", type=int, default=1)
    c.add_argument("--runs", type=int, default=5)
    c.add_argument("--output")
    c = sub.add_parser("environment")
    c.add_argument("--output")
    c = sub.add_parser("ingest")
    c.add_argument("--raw-dir", required=True)
    c.add_argument("--parquet-dir", required=True)
    c.add_argument("--ddl", required=True)
    c.add_argument("--tables", help="some of the tables, comma-separated")
    c.add_argument("--compression", default="snappy")
    c.add_argument("--validate-schema-only", action="store_true")
    c = sub.add_parser("validate")
    c.add_argument("--parquet-dir", required=True)
    c.add_argument("--expected", nargs="+", required=True, metavar="TABLE=ROWS")
    c = sub.add_parser("shapes")
    c.add_argument("--data-dir", required=True)
    c.add_argument("--sql", nargs="+", required=True, help="statements, or files of them")
    c.add_argument("--max-regions", type=int, default=1)
    c = sub.add_parser("footers")
    c.add_argument("columns")
    c.add_argument("path")
    a = p.parse_args(argv)
    if a.command == "run" and a.queries_dir and not a.output_dir:
        p.error("--queries-dir needs --output-dir")
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    out, ok = None, True
    if a.command == "run" and a.queries_dir:
        out = harness.run_files(spark, a.data_dir, a.queries_dir, a.output_dir, a.queries, a.warmups, a.runs, a.label)
    elif a.command == "run":
        out = {n: harness.run(lambda n=n: QUERIES[n](spark, a.data_dir), a.warmups, a.runs) for n in harness.chosen(list(QUERIES), a.queries)}
    elif a.command == "phases":
        sources.register(spark, a.data_dir)
        out = {name: harness.phases(spark, s) for name, text in statements(a.sql).items() for s in [text.strip().removesuffix(";")]}
    elif a.command == "compare":
        out = harness.compare_files(a.base, a.other, a.gate)
        ok = out["match"]
    elif a.command == "environment":
        out = harness.environment(spark)
    elif a.command == "synthetic" and a.action == "generate":
        harness.generate(spark, a.kind, a.path, a.rows)
    elif a.command == "synthetic":
        out = harness.benchmark(spark, a.kind, a.path, a.warmups, a.runs, a.expect)
    elif a.command == "ingest":
        schemas = sources.parse_schemas(Path(a.ddl).read_text())
        if a.tables:
            schemas = {n: schemas[n] for n in harness.chosen(list(schemas), a.tables)}
        out = {n: s.simpleString() for n, s in schemas.items()}
        if not a.validate_schema_only:
            for name, schema in schemas.items():
                df = sources.ingest(spark, sources.table_sources(spark, a.raw_dir, name), schema)
                sources.write_parquet(df, f"{a.parquet_dir}/{name}.parquet", a.compression)
    elif a.command == "validate":
        out = sources.validate(spark, a.parquet_dir, {k: int(v) for k, v in (x.split("=") for x in a.expected)})
        ok = all(r["ok"] for r in out)
    elif a.command == "shapes":
        out = [r.asDict() for r in shapes(spark, a.data_dir, statements(a.sql), a.max_regions).collect()]
    else:
        out = [r.asDict() for r in sources.footer_report(spark, a.path, a.columns.split(",")).collect()]
        ok = all(r["eligible"] for r in out)
    text = json.dumps(out, default=str, indent=1)
    if getattr(a, "output", None):
        Path(a.output).write_text(text)
    print(text)
    return 0 if ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
