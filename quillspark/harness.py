"""Runs queries repeatedly, compares results exactly and times their phases."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import time
from collections.abc import Callable
from pathlib import Path
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import Dimension, Join, fused_sum, membership_count
from quillspark.plans.shapes import metrics, walk
from quillspark.sources import register, split_inventory, synthetic_star, synthetic_sum, synthetic_values, write_parquet


def natural(names: list[str]) -> list[str]:
    """``q2`` before ``q10``."""
    return sorted(names, key=lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)])


def chosen(names: list[str], selection: str) -> list[str]:
    """``all`` or a comma-separated list; an unknown name raises."""
    if selection == "all":
        return natural(names)
    asked = [n.strip() for n in selection.split(",") if n.strip()]
    if unknown := [n for n in asked if n not in names]:
        raise KeyError(f"unknown queries: {', '.join(unknown)}")
    return asked


def digest(df: DataFrame) -> dict:
    """Rows, schema and SHA-256 of the sorted rows, values by position with their types."""
    rows = [json.dumps([[type(v).__name__, str(v)] for v in r]) for r in df.collect()]
    return {"rows": len(rows), "sha256": hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest(), "schema": df.schema.jsonValue()}


def run(make: Callable[[], DataFrame], warm_ups: int = 1, runs: int = 5) -> dict:
    """Median seconds and digest of a query; results that differ between runs raise."""
    seconds, result = [], None
    for k in range(warm_ups + runs):
        start = time.perf_counter()
        now = digest(make())
        if k >= warm_ups:
            seconds.append(time.perf_counter() - start)
        if result is not None and now != result:
            raise RuntimeError("results differ between runs")
        result = now
    return {"median": median(seconds), "seconds": seconds, **result}


def compare(base: dict, other: dict, gate: float = 1.10) -> dict:
    """Whether two legs agree in rows, hash and schema, and the ratio of their medians."""
    match = all(base[k] == other[k] for k in ("rows", "sha256", "schema"))
    speedup = base["median"] / other["median"]
    return {"match": match, "speedup": speedup, "gate": match and speedup >= gate}


def environment(spark: SparkSession) -> dict[str, str | int]:
    """Hardware and versions that a result depends on."""
    system = spark._jvm.java.lang.System
    return {
        "machine": platform.machine(),
        "system": platform.platform(),
        "cpus": os.cpu_count() or 0,
        "memory_mb": os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 20,
        "python": platform.python_version(),
        "java": system.getProperty("java.version"),
        "spark": spark.version,
        "master": spark.sparkContext.master,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "ansi": spark.conf.get("spark.sql.ansi.enabled"),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled"),
    }


def run_files(spark: SparkSession, data: str, folder: str, out: str, selection: str = "all", warm_ups: int = 1, runs: int = 5, label: str = "spark") -> dict:
    """Every chosen ``*.sql`` of ``folder`` over the tables of ``data``; ``out`` gets ``summary.json`` and a plan of each.

    A file is one statement, sent whole.  The plan is that of a run, so it
    shows what was decided while it ran, and its metrics are in the summary.
    """
    files = {f.stem: f for f in Path(folder).glob("*.sql")}
    register(spark, data)
    top = Path(out)
    top.mkdir(parents=True, exist_ok=True)
    summary: dict = {"label": label, "environment": environment(spark), "queries": {}}
    for name in chosen(list(files), selection):
        text, last = files[name].read_text().strip().removesuffix(";"), []

        def make(text=text, last=last) -> DataFrame:
            last[:] = [spark.sql(text)]
            return last[0]

        summary["queries"][name] = {**run(make, warm_ups, runs), "metrics": metrics(last[0])}
        (top / f"{name}-plan.txt").write_text(last[0]._jdf.queryExecution().toString())
    (top / "summary.json").write_text(json.dumps(summary, default=str, indent=1))
    return summary


def compare_files(base: str, other: str, gate: float = 1.10) -> dict:
    """:func:`compare` of every query of two summaries; one that only one leg has does not match."""
    legs = [json.loads(Path(f).read_text()) for f in (base, other)]
    names = natural(list({n for leg in legs for n in leg["queries"]}))
    judged = {n: compare(*(leg["queries"][n] for leg in legs), gate) if all(n in leg["queries"] for leg in legs) else {"match": False, "speedup": None, "gate": False} for n in names}
    return {"base": legs[0]["label"], "other": legs[1]["label"], "match": all(j["match"] for j in judged.values()), "gate": all(j["gate"] for j in judged.values()), "queries": judged}


def _timed(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def phases(spark: SparkSession, statement: str) -> dict[str, float]:
    """Seconds of the parts of a statement, each run alone, and of the whole.

    Parts are planning the first and the second time, listing files and row
    groups of its largest scan, computing what its joins broadcast, and
    decoding the columns that the scan reads.  They are taken from a plan
    without AQE; a statement without such a part has 0 there.
    """
    out = {}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("planning_cold", "planning_warm"):
            out[name] = _timed(lambda: spark.sql(statement)._jdf.queryExecution().executedPlan())
        nodes = list(walk(spark.sql(statement)._jdf.queryExecution().executedPlan()))
        scans = [n for n in nodes if n.nodeName().startswith("Scan parquet")]
        fact = max(scans, key=lambda n: n.relation().location().sizeInBytes(), default=None)
        sent = [n.child() for n in nodes if n.nodeName() == "BroadcastExchange"]
        out["split_enumeration"] = _timed(lambda: [split_inventory(spark, p.toString()).count() for p in roots(fact)]) if fact else 0.0
        out["dimension_collect"] = sum(_timed(lambda n=n: n.execute().count()) for n in sent)
        # batches are decoded when they are made, so counting them reads every column of the scan
        out["scan"] = _timed(lambda: (fact.executeColumnar() if fact.supportsColumnar() else fact.execute()).count()) if fact else 0.0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    out["end_to_end"] = _timed(lambda: spark.sql(statement).write.format("noop").mode("overwrite").save())
    return out


def roots(scan) -> list:
    """The paths that a file scan reads."""
    held = scan.relation().location().rootPaths()
    return [held.apply(k) for k in range(held.length())]


#: Threshold, factor and addend of the synthetic sum.
SUM = (500, 3, 7)

#: The filters of the synthetic star join, by dimension: key of the fact, key of the dimension, condition.
STAR = {"times": ("time_sk", "t_time_sk", "t_hour = 20 and t_minute >= 30"), "demos": ("demo_sk", "hd_demo_sk", "hd_dep_count = 7"), "stores": ("store_sk", "s_store_sk", "s_store_name = 'ese'")}


def generate(spark: SparkSession, kind: str, path: str, rows: int) -> None:
    """Writes the tables of a synthetic benchmark: ``sum``, ``star`` or ``star-edge``; a folder that holds them is refused."""
    made = {"values": synthetic_values(spark, rows)} if kind == "sum" else synthetic_star(spark, rows, kind == "star-edge")
    for name, df in made.items():
        write_parquet(df, f"{path}/{name}")


def benchmark(spark: SparkSession, kind: str, path: str, warm_ups: int = 1, runs: int = 5, expect: int | None = None) -> dict:
    """Times a synthetic benchmark and holds its one number against ``expect``; that of ``sum`` is known beforehand."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    if kind == "sum":
        values = read("values")
        expect = synthetic_sum(values.count(), *SUM) if expect is None else expect
        make = lambda: fused_sum(values, "value", *SUM)
    else:
        joins = [Join(key, Dimension(read(name).filter(where), own)) for name, (key, own, where) in STAR.items()]
        make = lambda: membership_count(read("fact"), joins)
    got = make().first()[0]
    if expect is not None and got != expect:
        raise RuntimeError(f"{kind} gives {got}, not {expect}")
    return {"kind": kind, "result": got, "expected": expect, "environment": environment(spark), **run(make, warm_ups, runs)}
