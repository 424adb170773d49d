"""Each registered query runs over the smallest tables with one row where one is due."""

import pytest

from quillspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.count()
    if name.split("_")[0] in ("op1", "op5", "op8", "op9", "op10"):
        assert rows == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    elif name.startswith("op2"):
        assert rows == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    else:
        assert rows


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = pipeline.run(spark, FOLDER)
    left = out.select("doc_id").distinct()
    assert 0 < left.count() < docs.count()
    assert left.join(docs, "doc_id", "left_anti").count() == 0
