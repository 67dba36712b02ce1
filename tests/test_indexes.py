"""The stored indexes against plain scans and sorts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tillbook.functions.exprs import contains_any
from tillbook.sources import indexes
from tillbook.sources.indexes import GramIndex, PageIndex

WORDS = ("Alpha", "alphabet", "ÉTÉ", "été", "a_b", "50%", "back\\slash", "ab", "😀😀😀x", "İstanbul", "ΟΔΟΣ", "new\nline", "")


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(3)
    pick = lambda: rnd.choice([None, *WORDS]) and " ".join(rnd.choices(WORDS, k=3))
    rows = [(None if i % 41 == 0 else i // 2, pick(), pick(), i) for i in range(400)]  # ids repeat, some are NULL
    return spark.createDataFrame(rows, "id long, a string, b string, n int").repartition(5)


@pytest.mark.parametrize("most", [0, indexes.ID_LIST])
def test_contains_search_finds_what_a_scan_finds(spark, table, tmp_path, monkeypatch, most):
    monkeypatch.setattr(indexes, "ID_LIST", most)
    index = GramIndex.build(table, str(tmp_path / "grams"), ("a", "b"))
    for term in ("ALPHA", "phabet", "été", "a_b", "50%", "lph%bet", "k\\s", "ab", "%", "x y z", "😀😀x", "i̇st", "ΟΔΟΣ", "w\nl", "absent", "_lpha"):
        want = sorted(r.n for r in table.filter(contains_any(term, "a", "b")).collect())
        assert sorted(r.n for r in index.matching(table, term).collect()) == want, term


def test_the_rarest_gram_is_read(spark, table, tmp_path):
    index = GramIndex.build(table, str(tmp_path / "grams"), ("a", "b"))
    assert index.rarest("ab") is None and index.rarest("a%b") is None
    gram, n = index.rarest("alphabet")
    assert gram in ("hab", "abe", "bet") and n <= index.rarest("alpha")[1]
    assert index.rarest("zzz alpha")[1] == 0
    plan = index.candidates(table, "alphabet")._jdf.queryExecution().toString()
    assert "INSET" in plan or " IN (" in plan


def test_postings_in_parts_of_bounded_size(spark, table, tmp_path, monkeypatch):
    """More texts make more parts, not larger ones, and a posting is there once though ids repeat."""
    monkeypatch.setattr(indexes, "TASK_GRAMS", 200, raising=False)
    index = GramIndex.build(table, str(tmp_path / "grams"), ("a", "b"))
    posted = index._postings()
    n = posted.count()
    assert posted.distinct().count() == n
    parts = [r["count"] for r in posted.groupBy(F.input_file_name()).count().collect()]
    assert len(parts) > 16 and max(parts) < n / 8  # 8 shuffle partitions
    want = {(r.gram, r.n) for r in posted.groupBy("gram").agg(F.count_distinct("id").alias("n")).collect()}
    assert {(r.gram, r.n) for r in spark.read.parquet(str(tmp_path / "grams" / "grams")).collect()} == want


def test_an_empty_table_has_an_index(spark, table, tmp_path):
    index = GramIndex.build(table.limit(0), str(tmp_path / "grams"), ("a", "b"))
    assert index.matching(table.limit(0), "alpha").collect() == []
    pages = PageIndex.build(table.limit(0), str(tmp_path / "pages"), (("n", False),))
    assert pages.page(table, 1, 10).collect() == []


def test_pages_are_those_of_the_sorted_table(spark, table, tmp_path):
    order = (("a", True), ("id", False), ("n", True))
    index = PageIndex.build(table, str(tmp_path / "pages"), order, block_rows=37)
    want = [r.n for r in table.orderBy(F.col("a").desc_nulls_last(), F.col("id").asc_nulls_first(), F.col("n").desc()).collect()]
    for limit in (1, 7, 150):
        for page in (1, 2, 3, 5, 58, 400, 401):
            assert [r.n for r in index.page(table, page, limit).collect()] == want[(page - 1) * limit: page * limit], (limit, page)
    plan = index.page(table, 30, 7)._jdf.queryExecution().toString()
    pruned = re.search(r"PartitionFilters: \[block#\d+ (?:IN \(([^)]*)\)|= (\d+))", plan) or re.search(r"PartitionFilters: \[isnotnull\(block#\d+\), \(block#\d+ = (\d+)\)", plan)
    assert pruned, plan
    assert len([g for g in pruned.groups() if g][0].split(",")) <= 2
