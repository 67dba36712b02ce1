"""Ranked lexical search with the Best Position Algorithm over impact lists.

A document's score for a query is the sum of the integer impacts of the query's distinct terms (see ``weight`` and
``impacts``). The documents are cut into blocks of bounded postings. In a block every query term has an impact list:
its documents by falling impact, then id. A query reads its lists in parallel from the top (sorted access). Each
document met for the first time is looked up in all other lists (direct access), which gives its whole score and its
positions there. The best position of a list is the last one up to which all have been seen, either way; the
sum of the impacts at the best positions bounds every document not met yet. Reading stops when that bound lies
strictly below the k-th best score, so that no tie is lost. The blocks' best k meet in one top-k per query.

N, L and df are counted over all documents first, in the pass that makes the postings. The queries are worked on in
blocks of at most ``QUERY_BYTES`` of text (or one longer text): their dictionary and weights are what goes to the tasks.

NULL, empty and wordless texts are neither documents nor queries with a result. Repeated document rows rank as rows of
their own; repeated query rows count once, and rows that share an item_id but differ in text are ranked apart.
Equal scores: ascending doc_id, NULL last. An empty table on either side gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import cut, per_batch
from tillbook.llm.sharding import block_offsets, in_order

TOP = 50
#: Text of the queries worked on at once; bounds the dictionary that is sent to the tasks.
QUERY_BYTES = 1 << 20
#: Postings ranked at once in one task.
BLOCK_POSTINGS = 1 << 21
#: Positions first read from each list; doubled from round to round.
FIRST_DEPTH = 64
#: Bytes that stand between terms become blanks, A-Z become a-z, all others (UTF-8 beyond ASCII included) stay.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
             for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    """All terms of a text in order, repeats included."""
    return ((text.encode() if isinstance(text, str) else text) or b"").translate(FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """w * (10^9 tf div (1000 tf + 20 m)), m = 100 - 50 + (50 n N) div L: all integers."""
    m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n.tolist()], np.int64) if len(n) and int(n.max()) * n_docs > 1 << 56 \
        else 50 + 50 * n * n_docs // n_terms
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The distinct queries, some at a time: rows (item_id, text)."""
    q = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = F.octet_length("text").cast("long")
    q = in_order(q.withColumn("size", size), [F.col("item_id"), F.xxhash64("text")], "queries")
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    q = cut(q.join(block_offsets(q, before=F.sum("size")), "block").select(
        "item_id", "text", F.floor(upto / QUERY_BYTES).alias("part")), "query-blocks")
    last = q.agg(F.max("part")).first()[0]
    for part in range(0 if last is None else last + 1):
        yield [tuple(r) for r in q.where(F.col("part") == part).select("item_id", "text").collect()]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), and the vocabulary's terms in the document with their counts; n > 0 only."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, n, term, tf = [], [], [], []
        for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = terms(text)
            if words:
                own = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                ids.append(d)
                n.append(len(words))
                term.append([t for t, _ in own])
                tf.append([c for _, c in own])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, n, term, tf), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_batch(rows, count, "doc_id long, n long, term array<int>, tf array<long>")


class ImpactLists:
    """The impact lists of one block: postings of (term, document), documents numbered by ascending id."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        some = impact > 0
        term, doc, impact = term[some], doc[some], impact[some]
        ranked = np.lexsort((doc, -impact, term))
        self.ranked_doc, self.ranked_impact = doc[ranked], impact[ranked]
        self.ends = np.cumsum(np.bincount(term, minlength=n_terms))
        self.starts = self.ends - np.bincount(term, minlength=n_terms)
        # the same postings by document, for direct access, with the position of each in its list
        at = np.empty(len(term), np.int64)
        at[ranked] = np.arange(len(term))
        by_doc = np.lexsort((doc, term))
        self.doc, self.impact, self.position = doc[by_doc], impact[by_doc], (at - self.starts[term])[by_doc]
        self.n_docs = n_docs

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the k highest scores above 0 for a set of terms, and the scores."""
        lists = [(int(self.starts[t]), int(self.ends[t])) for t in query if self.ends[t] > self.starts[t]]
        met, score = np.zeros(self.n_docs, bool), np.zeros(self.n_docs, np.int64)
        seen = [np.zeros(b - a, bool) for a, b in lists]
        position = [0] * len(lists)  # best positions: all places before these have been seen
        low, high, found = 0, FIRST_DEPTH, []
        while lists:
            read = [self.ranked_doc[a + low:min(b, a + high)] for a, b in lists]
            fresh = np.unique(np.concatenate(read))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            found.append(fresh)
            bound = 0
            for i, (a, b) in enumerate(lists):
                seen[i][low:high] = True
                at = a + np.searchsorted(self.doc[a:b], fresh)
                inside = at < b
                inside[inside] = self.doc[at[inside]] == fresh[inside]
                score[fresh[inside]] += self.impact[at[inside]]
                seen[i][self.position[at[inside]]] = True
                ahead = seen[i][position[i]:]
                position[i] += len(ahead) if ahead.all() else int(ahead.argmin())
                if position[i] < b - a:  # of a list seen to its end nothing is left
                    bound += int(self.ranked_impact[a + position[i] - 1])
            n = sum(map(len, found))
            if bound == 0 or n >= k and np.partition(score[met], n - k)[n - k] > bound:
                break
            low, high = high, 2 * high
        docs = np.flatnonzero(met)
        docs = docs[np.lexsort((docs, -score[docs]))[:k]]
        return docs, score[docs]


def rank_blocks(rows: DataFrame, queries: list[np.ndarray], w: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): the best k of every query in each block of documents."""
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t.column("doc_id"), null_placement="at_end")).combine_chunks()
        each = pc.list_value_length(t.column("term")).to_numpy()
        doc = np.repeat(np.arange(t.num_rows), each)
        term = pc.list_flatten(t.column("term")).to_numpy()
        tf = pc.list_flatten(t.column("tf")).to_numpy()
        lists = ImpactLists(term, doc, impacts(w[term], tf, np.repeat(t.column("n").to_numpy(), each), n_docs, n_terms), t.num_rows, len(w))
        for i, q in enumerate(queries):
            docs, score = lists.best(q, k)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i, np.int32)),
                                                  t.column("doc_id").take(pa.array(docs)).combine_chunks(), pa.array(score)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            size = len(batch.column("term").flatten())
            if held and n + size > BLOCK_POSTINGS:
                yield from block(held)
                held, n = [], 0
            held.append(batch)
            n += size
        if held:
            yield from block(held)

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents with the highest scores above 0 for each query."""
    spark = docs.sparkSession
    item = queries.schema[item_col].dataType
    out = spark.createDataFrame([], f"item_id {item.simpleString()}, rank int, doc_id long, score long")
    for items in query_blocks(queries, item_col, item_text_col):
        words = [sorted(set(terms(text))) for _, text in items]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
        if not vocabulary:
            continue
        found = cut(postings(docs, vocabulary, id_col, text_col), "postings")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        w = np.full(len(vocabulary), weight(n_docs, 0), np.int64)
        for r in found.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row per word of the block's queries
            w[r.t] = weight(n_docs, r["count"])
        best = rank_blocks(found, [np.array([vocabulary[x] for x in q], np.int64) for q in words], w, n_docs, n_terms, k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"query int, item_id {item.simpleString()}")
        out = out.unionAll(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out
