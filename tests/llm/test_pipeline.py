"""``corpus_pipeline.run`` against a plain chain of the five stages."""

from __future__ import annotations

import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import HAZARDS, PRIVATE
from tokenizers import Tokenizer

from tillbook.llm import bpe, language_id, queries


def plain(docs, items):
    """Rows (doc_id, text, lang) through all stages."""
    learned = [(t, lang) for d, t, lang in docs if d is None or zlib.crc32(str(d).encode()) % 3 != 1]
    found = brute.languages([(d, t) for d, t, _ in docs], learned, language_id.vocabulary())
    rows = [(d, t) for (d, t, _), (lang, score) in zip(docs, found, strict=True) if lang != "und" and score >= .5]
    best = {}
    for (d, t), (_, group) in zip(rows, brute.simhash_groups(rows), strict=True):
        mine = (d is None, d or 0, t)
        best[group] = min(best.get(group, mine), mine)
    rows = [(None if none else d, t) for none, d, t in best.values()]
    rows = [r for r, x in zip(rows, brute.decontaminate(rows, items), strict=True) if not x[-1]]
    library = Tokenizer.from_file(bpe.VOCABULARY)
    for (d, _), t in zip(rows, brute.sanitised(rows), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        yield d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(library.decode(ids, skip_special_tokens=False))


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)


def test_run_on_the_smallest_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = sorted(plain(docs, items), key=repr)
    assert result(corpus_pipeline.run(spark, SF)) == expected and 100 < len(expected) < 200


@pytest.fixture
def tables(spark, monkeypatch):
    def use(docs, items):
        df = spark.createDataFrame([(d, t, lang, None, 0) for d, t, lang in docs],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        for name in ("k", "h", "row", "spans", "fp", "root", "term", "score", "ids", "found"):
            df = df.withColumn(name, F.lit("clash"))
        made = {"documents": df, "benchmark": spark.createDataFrame(items, "item_id long, text string")}
        monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: made[name])
        return df
    return use


BENCH = [(1, " ".join(f"word{c}" for c in "abcdefghijklmnop")), (2, None), (None, "")]


def test_run_on_odd_documents(spark, tables):
    """NULLs, empty and long texts, repeats, shared ids, clashing columns, a benchmark passage, personal data."""
    odd = HAZARDS + PRIVATE + [(60, "some words before " + BENCH[0][1] + " after it"), (61, BENCH[0][1].upper())]
    docs = [(d, t, ("la", "lb", None)[i % 3]) for i, (d, t) in enumerate(odd)]
    items = [b for b in BENCH if b[0] is not None]
    tables(docs, items)
    expected = sorted(plain(docs, items), key=repr)
    got = result(corpus_pipeline.run(spark, ""))
    assert got == expected and len(got) > 8 and not {60, 61} & {d for d, *_ in got}


def test_stages_keep_the_columns(spark, tables):
    docs = tables([(1, "the cat and the dog mail a@b.org", "en"), (2, "le chat et le chien", "fr"), (3, "the cat", None)], BENCH)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "clash" in docs.first().asDict().values()
    assert {r.doc_id: r.n_chars == len(r.text) for r in docs.collect()} == {1: True, 2: True, 3: True}


def test_empty_tables(spark, tables):
    tables([], [])
    assert corpus_pipeline.run(spark, "").collect() == []
    tables([(1, None, "en"), (None, "", None), (3, "123 !", "fr")], [])
    assert corpus_pipeline.run(spark, "").collect() == []
