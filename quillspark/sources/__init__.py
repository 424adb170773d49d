"""Tables in and out: registration, delimited text, Parquet, validation and footers."""

from quillspark.sources.footers import footer_report, split_inventory
from quillspark.sources.tables import ingest, parse_schemas, register, synthetic_star, synthetic_sum, synthetic_values, table_sources, tables, validate, write_parquet

__all__ = ["footer_report", "ingest", "parse_schemas", "register", "split_inventory", "synthetic_star", "synthetic_sum", "synthetic_values", "table_sources", "tables", "validate", "write_parquet"]
