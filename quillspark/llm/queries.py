"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.decontam import contaminated
from quillspark.llm.jaccard import jaccard_components
from quillspark.llm.langid import identify
from quillspark.llm.licenses import scan_licenses
from quillspark.llm.packing import pack
from quillspark.llm.pii import detect, learn
from quillspark.llm.simple8b import token_output
from quillspark.llm.suffix import remove_repeats
from quillspark.llm.urlfilter import judge_urls, oracle
from quillspark.llm.vafile import search

#: The rules of the contract.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and ``text``, what is left; half a character at the edge of a removed run is U+FFFD there."""
    left = remove_repeats(table(spark, sf_dir, "documents")).withColumn("text", F.expr("make_valid_utf8(CAST(kept AS STRING))"))
    return left.drop("spans", "kept")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_va_file_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 2048, end_id=1, with_tokens=False)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_grouped_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, learn(docs))


def op10_simple8b_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_templates": op2_url_templates,
    "op3_va_file_top10": op3_va_file_top10,
    "op4_latent_decontamination": op4_latent_decontamination,
    "op5_ppm_language": op5_ppm_language,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_license_scan": op7_license_scan,
    "op8_grouped_prefix_jaccard": op8_grouped_prefix_jaccard,
    "op9_bootstrapped_pii": op9_bootstrapped_pii,
    "op10_simple8b_output": op10_simple8b_output,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_templates": oracle(URL_RULES),
}
