"""Ranked search, mixing and conversation repair against plain versions."""

from __future__ import annotations

import collections
import random

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tillbook.llm import conversation_repair, lexical_search, mixing, queries

Q = queries.QUERIES


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


# ---- ranked search

DOCS = [(1, None), (2, ""), (3, " .,!"), (4, "the cat"), (4, "the cat"), (5, "THE CAT sat on the mat"), (None, "the cat"), (6, "été Été ÉTÉ 42"),
        (7, "cat " * 40_000), (8, "x"), (9, "dog"), (9, "another dog"), (10, "a_b-c d1e")]
ITEMS = [(1, "The the cat"), (1, "The the cat"), (2, "été 42 dog"), (3, None), (4, ""), (None, "x b"), (5, "no such words"), (4, "dog")]


def test_search(spark, rows, frame):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    same(Q["op11_ranked_search"](spark, SF), brute.search(rows, items))
    frame(DOCS, {"benchmark": (ITEMS, "item_id long, text string")})
    same(Q["op11_ranked_search"](spark, ""), brute.search(DOCS, ITEMS))
    frame([], {"benchmark": (ITEMS, "item_id long, text string")})
    assert Q["op11_ranked_search"](spark, "").collect() == []
    frame(DOCS, {"benchmark": ([(1, None), (2, "?!")], "item_id long, text string")})
    assert Q["op11_ranked_search"](spark, "").collect() == []


def test_search_in_many_blocks(spark, frame, monkeypatch):
    """Small blocks of queries and of documents give the same ranks."""
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 25)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(lexical_search, "FIRST_DEPTH", 2)
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(60)], k=r.randint(1, 60)))) for i in range(300)]
    items = [(i, " ".join(r.choices(words, k=8))) for i in range(9)]
    frame(docs, {"benchmark": (items, "item_id long, text string")})
    same(Q["op11_ranked_search"](spark, ""), brute.search(docs, items))


def test_best_positions_stop_early():
    """The lists are not read to their ends, and ties at the k-th place are kept by id."""
    r = np.random.default_rng(3)
    n, terms = 5000, 4
    impact = r.integers(1, 1_000_000, (terms, n))
    impact[:, 100:120] = 2_000_000  # 20 equal documents at the top
    term, doc = (x.ravel() for x in np.mgrid[:terms, :n])
    lists = lexical_search.ImpactLists(term, doc, impact.ravel(), n, terms)
    reads = []
    lists.ranked_doc = type("Counted", (), {"__getitem__": lambda self, s, a=lists.ranked_doc: reads.append(s) or a[s]})()
    found, score = lists.best(np.arange(terms), 10)
    assert found.tolist() == list(range(100, 110)) and set(score.tolist()) == {8_000_000}
    assert max(s.stop - s.start for s in reads) <= lexical_search.FIRST_DEPTH and len(reads) <= 2 * terms


# ---- mixing

def check_mix(rows, result):
    size = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goal = brute.mix_targets(sizes)
    assert collections.Counter((d, size(t), sizes[s], round(goal[s], 6)) for d, t, s in rows) == collections.Counter(
        (r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in result)
    assert all(0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in result)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("clash")).withColumn("size", F.lit(1))


MIXED = [(i, "w " * (i % 7), f"s{i % 5}") for i in range(60)] + [(100, None, "s1"), (101, "", None), (102, "a b c", None), (None, "x y", "é"),
         (5, "other", "s0"), (200, "big " * 500, "zz"), (200, "big " * 500, "zz"), (7, "w", ""), (8, None, "only null")]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame_of(spark, MIXED))
    result = Q["op12_mixing"](spark, "").collect()
    check_mix(MIXED, result)
    assert sorted(map(repr, result)) == sorted(map(repr, Q["op12_mixing"](spark, "").collect()))
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame_of(spark, []))
    assert Q["op12_mixing"](spark, "").collect() == []
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame_of(spark, [(1, None, "a"), (2, "", None)]))
    assert [(r.target, r.taken) for r in Q["op12_mixing"](spark, "").collect()] == [(0.0, 0)] * 2


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, draws = mixing.mix(docs)
    rows, draws = rows.collect(), draws.collect()
    check_mix([tuple(r) for r in docs.select("doc_id", "text", "source").collect()],
              [type("R", (), {**r.asDict(), "taken": r.size * sum(d.row == r.row for d in draws)}) for r in rows])
    size, source = {r.row: r.size for r in rows}, {r.row: r.source for r in rows}
    taken, largest = collections.Counter(), collections.Counter()
    for d in draws:
        taken[source[d.row]] += size[d.row]
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[r.source] - r.target) <= largest[r.source] / 2 + 1 for r in rows)
    by = collections.defaultdict(list)
    for d in draws:
        by[d.shard].append(d.slot)
    assert set(by) <= set(range(mixing.SHARDS)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({(d.row, d.copy) for d in draws}) == len(draws)
    words = collections.Counter()
    for d in draws:
        words[d.shard] += size[d.row]
    mean = sum(words.values()) / mixing.SHARDS
    assert all(0.5 * mean < words[s] < 1.6 * mean for s in range(mixing.SHARDS))  # of some 40 documents each
    share = collections.Counter((d.shard, source[d.row]) for d in draws)
    assert len(share) > mixing.SHARDS * 12  # sources are spread over the shards


def test_many_sources_share_tapes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TAPES", 3)
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    rows, draws = mixing.mix(frame_of(spark, MIXED))
    times = draws.groupBy("row").agg(F.count("*").alias("n"))
    check_mix(MIXED, rows.join(times, "row", "left").withColumn("taken", F.col("size") * F.coalesce("n", F.lit(0))).collect())


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_quotas_split_exactly(shards):
    quotas = [7, 0, 100, 13, 1]
    leaves = mixing.split(quotas, shards)
    assert len(leaves) == shards and [sum(x) for x in zip(*leaves, strict=True)] == quotas
    assert all(abs(sum(x) - 121 / shards) < 6 for x in leaves) and leaves == mixing.split(quotas, shards)


def test_split_is_hypergeometric():
    """Mean and variance of one source's share of the left half."""
    got = np.array([mixing.split([30, 70], 2, seed)[0][0] for seed in range(3000)])
    assert abs(got.mean() - 15) < 0.2 and abs(got.var() - 50 * 0.3 * 0.7 * 50 / 99) < 0.4


# ---- conversation repair

def convs(r, n, roles=("user", "assistant", "system", "user", "assistant", "tool", None, "")):
    for c in range(n):
        for t in range(r.randint(0, 9)):
            turn = r.choice([t, t, t, t + 3, None])
            text = r.choice(["a.", "b!", "no end", "", "\t", None, "x. \n", "c?", "a."])
            yield (r.choice([c, c, c, None]) if r.random() < .05 else c, turn, ("user", "assistant")[t % 2] if r.random() < .6 else r.choice(roles), text)


def use(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("n", "seq", "rows", "fault", "sig", "audit"):
        df = df.withColumn(name, F.lit("clash"))
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: df)


def test_repair(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(Q["op13_conversation_repair"](spark, SF), brute.repair(rows))
    odd = list(convs(random.Random(1), 400))
    odd += odd[:40] + [(9999, 2, "user", "long. " * 60_000), (9999, 3, "assistant", " " * 200_000 + "."), (9999, 4, "user", "x" + " " * 300_000 + "y")]
    use(spark, monkeypatch, odd)
    same(Q["op13_conversation_repair"](spark, ""), brute.repair(odd))
    use(spark, monkeypatch, [])
    assert Q["op13_conversation_repair"](spark, "").collect() == []


def test_repair_of_long_conversations(spark, monkeypatch):
    """Conversations cut into blocks of a few rows, over several tasks."""
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 3)
    r = random.Random(8)
    odd = list(convs(r, 30)) + [(77, t, r.choice(["user", "assistant", "user", "system"]), r.choice(["a.", "b", "c!", " ", f"{t}?"])) for t in range(400)]
    use(spark, monkeypatch, odd)
    same(Q["op13_conversation_repair"](spark, ""), brute.repair(odd))


def test_least_audit_of_random_lattices():
    """Both heaps against the plain recursion, and the costs between states against single searches."""
    r = random.Random(5)
    for _ in range(3000):
        items = [r.choice([("u", 0, 0), ("a", 0, 0), ("u", 1, 0), ("a", 1, 0), ("s", 0, 0), ("t", 0, 0), (None, 0, 1), (None, 0, 3)])
                 for _ in range(r.randint(0, 8))]
        exits = tuple(r.choice([0, 1, 2, 5, conversation_repair.FAR]) for _ in range(4))
        best = {(len(items), s): (c, "") for s, c in enumerate(exits) if c < conversation_repair.FAR}
        for i in range(len(items) - 1, -1, -1):
            for _ in range(4):
                for s in range(4):
                    for letter, w, to in conversation_repair.ahead(items, (i, s)):
                        if to in best:
                            name = "D" * items[i][2] if letter == "D" and items[i][0] is None else letter
                            way = (best[to][0] + w, name + best[to][1])
                            best[i, s] = min(best.get((i, s), way), way)
        costs = conversation_repair.between(items)
        for s in range(4):
            found = conversation_repair.solve(items, s, exits)
            assert (None if found is None else (found[1] + exits[found[2]], found[0])) == best.get((0, s))
            if found is not None:
                assert min(costs[4 * s + t] + exits[t] for t in range(4)) == best[0, s][0]
