import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_chain_and_do_what_they_say(spark, pipeline):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        sizes.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0
    last = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert set(columns) < set(last.columns) and last.count() == sizes[-1]
    assert sorted(r["doc_id"] for r in pipeline.run(spark, SMALL).select("doc_id").collect()) == sorted(r["doc_id"] for r in last.select("doc_id").collect())


def test_an_empty_table_goes_through(spark, pipeline):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_one_query_per_operator():
    code = "import __spark_entry__ as e; print(*e.queries())"
    names = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names
