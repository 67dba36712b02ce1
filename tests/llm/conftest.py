from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture
def frame(spark, monkeypatch):
    """Puts hand-made documents (and other tables) in the place of the queries' tables."""
    from pyspark.sql import functions as F

    from tillbook.llm import queries

    def use(rows, more=None):
        docs = spark.createDataFrame([(*r, None, None, None) for r in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long")
        # names the operators use for columns of their own
        for name in ("k", "h", "row", "spans", "fp", "id", "x", "g", "n_words", "pos", "score", "chars", "edits"):
            docs = docs.withColumn(name, F.lit("clash"))
        tables = {"documents": docs, **{n: spark.createDataFrame(r, s) for n, (r, s) in (more or {}).items()}}
        monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: tables[name])
        return docs
    return use
