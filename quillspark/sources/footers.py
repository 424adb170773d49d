"""What Parquet footers say: row groups, and whether columns suit a dictionary-driven scan.

Tasks read the footers of the files they are dealt; the driver holds names only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: What the eligible chunks have.
PHYSICAL = ("INT32",)
COMPRESSION = ("SNAPPY", "UNCOMPRESSED")
ENCODINGS = ("RLE", "BIT_PACKED", "PLAIN_DICTIONARY", "RLE_DICTIONARY")

_FIELDS = "file string, row_group int, rows bigint, bytes bigint, column_name string, physical string, compression string, encodings string, max_definition int, max_repetition int"


@lru_cache(maxsize=512)
def _footer(name: str, size: int, modified: int, columns: tuple[str, ...] | None) -> tuple[tuple, ...]:
    """Chunks of one file's named columns, or its row groups with empty columns; a worker keeps the last ones.

    ``size`` and ``modified`` are part of the key, so a file written anew is read again.
    """
    import pyarrow.parquet as pq

    store, path = _opened(name)
    out = []
    with store.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
        places = [c for c in range(meta.num_columns) if meta.schema.column(c).path in (columns or ())]
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            if columns is None:
                out.append((name, g, group.num_rows, group.total_byte_size, None, None, None, None, None, None))
            for c in places:
                x, leaf = group.column(c), meta.schema.column(c)
                out.append((name, g, group.num_rows, group.total_byte_size, x.path_in_schema, x.physical_type, x.compression, ",".join(sorted(set(x.encodings))), leaf.max_definition_level, leaf.max_repetition_level))
    return tuple(out)


def _opened(name: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)


def _footers(columns: tuple[str, ...] | None):
    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in files:
            out = []
            for name in some["file"]:
                store, path = _opened(name)
                info = store.get_file_info(path)
                out += _footer(name, info.size, info.mtime_ns or 0, columns)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _FIELDS.split(", ")]).astype(object)

    return run


def _chunks(spark: SparkSession, path: str, columns: tuple[str, ...] | None) -> DataFrame:
    files = spark.read.parquet(path).inputFiles()
    spread = spark.createDataFrame([(f.replace("file:///", "file:/").replace("file:/", "file:///"),) for f in files], "file string")
    return spread.repartition(max(1, min(len(files), 4096))).mapInPandas(_footers(columns), _FIELDS)


def split_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_group, rows, bytes`` of every row group; one row of each is made, no column is looked at."""
    return _chunks(spark, path, None).select("file", "row_group", "rows", "bytes")


def footer_report(spark: SparkSession, path: str, columns: list[str], plain_allowed: bool = False) -> DataFrame:
    """``file, column_name, eligible, reason`` for each file and named column.

    ``plain_allowed`` is the rule for measures and grouped keys; membership keys
    need every page encoded by a dictionary.
    """
    encodings = (*ENCODINGS, *(["PLAIN"] if plain_allowed else []))
    of = lambda names: ", ".join(f"'{n}'" for n in names)
    reason = f"""CASE WHEN physical NOT IN ({of(PHYSICAL)}) THEN concat('physical type ', physical)
        WHEN max_repetition > 0 THEN 'repeated column'
        WHEN max_definition > 1 THEN 'nested column'
        WHEN compression NOT IN ({of(COMPRESSION)}) THEN concat('compression ', compression)
        WHEN size(array_except(split(encodings, ','), array({of(encodings)}))) > 0 THEN concat('encodings ', encodings)
        ELSE '' END"""
    return _chunks(spark, path, tuple(columns)).selectExpr("file", "column_name", f"{reason} AS r").groupBy("file", "column_name").agg({"r": "max"}).selectExpr("file", "column_name", "`max(r)` = '' AS eligible", "`max(r)` AS reason")
