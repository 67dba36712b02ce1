"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give entities away.

The base kinds (e-mail, IP address, payment card, phone) are found by pattern and check. Each distinct value is a
protected entity e. Terms t are all words of the documents that hold e, but for those inside entities. With counts
of documents,

    disclosure(t, e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

is the share of the entity's information that the term reveals: 1 if t occurs only together with e. A term at or
beyond ``DISCLOSURE`` whose n(t, e) is no chance is sanitised wherever it stands, in all documents: numbers are
generalised to ``[NUMBER]``, words to ``[TERM]``, and the entities to the name of their kind.

No chance: the chance of n(t, e) or more, were t and e independent, is bounded by Hoeffding's exp(-n D(n(t, e)/n, q))
for hypergeometric counts, n and q being n(e) and n(t)/N or the other way round, whichever bounds it better. Times
the pairs tested (terms times entities that two rows or more hold, and N at least) it must be ``LEVEL`` or less. One
row that holds both has a chance of 1/N or more, so it never is enough, and such pairs are left out at once.

N and n(t) count all rows, n(e) and n(t, e) all that hold entities. n(t) is needed for terms of pairs only: a
fixed-size sieve drops the others before the counts are shuffled, and the join is exact. The same goes for the
places of the flagged terms.

NULL and empty texts have no spans. Rows that agree in id and text are one document and get one result each.
Spans are in code points, end exclusive. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import cut, doc_key, in_sieve, per_batch, pieces, sieve

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    # from the first digit of a run only: a match from a later one would have matched from there
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
WORDS = re.compile(r"\w+")
DISCLOSURE = 0.9
#: Expected number of flagged pairs, over all pairs tested, that are there by chance.
LEVEL = 0.01
#: Distinct terms a task counts before it hands them on.
KEPT_TERMS = 100_000


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, text: str) -> bool:
    """The check of a base kind on a pattern's match."""
    if kind == "ip":
        return all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))
    if kind == "card":
        number = digits(text)
        return 12 <= len(number) <= 19 and luhn(number)
    return kind != "phone" or 9 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@`` and ``DOMAIN``, leftmost, not overlapping, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the kind, normalised value), by start, then kind."""
    out = [(a, b, 0, text[a:b].lower()) for a, b in emails(text)]
    for i, kind in enumerate(KINDS[1:4], 1):
        if kind == "phone" and "+" not in text:
            continue
        out += [(m.start(), m.end(), i, m[0] if kind == "ip" else digits(m[0]))
                for m in PATTERNS[kind].finditer(text) if passes(kind, m[0])]
    return sorted(out, key=lambda x: (x[0], x[2]))


def free_words(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words outside of the entities."""
    words = [m for m in WORDS.finditer(text)]
    starts, ends = np.array([m.start() for m in words]), np.array([m.end() for m in words])
    free = np.ones(len(words), bool)
    for a, b, _, _ in spans:
        free[np.searchsorted(ends, a, "right"): np.searchsorted(starts, b)] = False
    return [(m[0].lower(), m.start(), m.end()) for m in compress(words, free.tolist())]


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode())


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, doc_id, base, terms), one row per input row; terms: the distinct free words of a text with entities."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, terms = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text) if text else []
            base.append([{"first": a, "kind": i, "last": b, "value": v} for a, b, i, v in spans])
            terms.append([{"term": t, "h": np.uint64(term_hash(t)).astype(np.int64).item()}
                          for t in sorted({t for t, _, _ in free_words(text, spans)})] if spans else [])
        return pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("doc_id"),
             pa.array(base, pa.list_(pa.struct([("first", pa.int32()), ("kind", pa.int32()), ("last", pa.int32()),
                                                ("value", pa.string())]))),
             pa.array(terms, pa.list_(pa.struct([("term", pa.string()), ("h", pa.int64())])))],
            ["k", "doc_id", "base", "terms"])

    text = F.col(text_col)
    rows = docs.select(doc_key(F.col(id_col), text).alias("k"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return per_batch(rows, fn, "k string, doc_id long, base array<struct<first int, kind int, last int, value string>>, "
                     "terms array<struct<term string, h long>>")


def term_counts(docs: DataFrame, text_col: str, bits: np.ndarray) -> DataFrame:
    """(term, n): in how many of the rows each term that the sieve lets pass occurs, over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                                pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for piece in pieces(batch):
                for text in piece.column("text").to_pylist():
                    terms = list(set(map(str.lower, set(WORDS.findall(text))))) if text else []
                    hashes = np.fromiter(map(term_hash, terms), np.uint64, len(terms))
                    counts.update(compress(terms, in_sieve(shared.value, hashes).tolist()))
                if len(counts) > KEPT_TERMS:
                    yield out()
        yield out()

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def places(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """(k, term, first, last) of the free words that the sieve lets pass, in all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
            terms = list(set(map(str.lower, set(WORDS.findall(text))))) if text else []
            hashes = np.fromiter(map(term_hash, terms), np.uint64, len(terms))
            here = set(compress(terms, in_sieve(shared.value, hashes).tolist()))
            if here:
                out += [(k, *x) for x in free_words(text, base_spans(text)) if x[0] in here]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()),
                                                                          strict=True)], ["k", "term", "first", "last"])

    text = F.col(text_col)
    rows = docs.select(doc_key(F.col(id_col), text).alias("k"), text.alias("text"))
    return per_batch(rows, fn, "k string, term string, first int, last int")


def divergence(both: Column, n: Column, q: Column) -> Column:
    """n D(both / n, q), D being the relative entropy of two coins; ``log`` of 0 is NULL."""
    a = both / n
    return n * (a * F.log(a / q) + F.coalesce((1 - a) * (F.log(1 - a) - F.log(1 - q)), F.lit(0.0)))


def entity_groups(holders: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(row, held, same): the entities of each row that more than one row and not all rows hold; and how many there are.

    Entities that the same rows hold have all counts in common, so they are one group; ``same`` is a digest of those rows.
    """
    entity = F.array_distinct(F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))
    each = holders.select("row", F.explode(entity).alias("x")).select("row", "x.*")
    digest = [F.sum(F.xxhash64(F.lit(i), "row").cast("decimal(38,0)")).alias(f"d{i}") for i in range(2)]
    held = cut(each.groupBy("kind", "value").agg(F.count("*").alias("held"), *digest)
               .where((F.col("held") > 1) & (F.col("held") < total)), "entity-counts")
    groups = each.join(held, ["kind", "value"]).select("row", "held", F.xxhash64("held", "d0", "d1").alias("same")).distinct()
    return groups, held.count()


def flagged_terms(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(term, th): the terms that reveal an entity.

    A term that reveals e is in N**0.1 * n(e)**0.9 rows at most, or its gain is too small even if all rows of e hold it. The
    rows with entities that hold a term are a part of its rows, so their number sorts out terms before any pair is made.
    """
    total = found.count()
    holders = found.where(F.size("base") > 0)
    groups, entities = entity_groups(holders, total)
    words = holders.select("row", F.explode("terms").alias("t")).select("row", F.col("t.term").alias("term"), F.col("t.h").alias("th"))
    among = cut(words.groupBy("term").agg(F.count("*").alias("least")), "holders-terms")
    rare = words.join(among.where("least > 1"), "term")
    most = F.pow(F.lit(float(total)), F.lit(1 - DISCLOSURE)) * F.pow("held", F.lit(DISCLOSURE)) * (1 + 1e-9)
    pairs = cut(groups.join(rare, "row").where(F.col("least") <= most)
                .groupBy("same", "held", "term", "th").agg(F.count("*").alias("both")).where(F.col("both") > 1), "entity-terms")
    tested = max(total, entities * among.count())
    n, e, both, rows = F.col("n"), F.col("held"), F.col("both"), F.lit(float(total))
    gain = F.log(rows * both / (n * e))
    sure = F.greatest(divergence(both, e, n / rows), divergence(both, n, e / rows))
    counts = cut(term_counts(docs, text_col, sieve(pairs, "th")), "term-counts")  # so that a hot term's pairs can be split
    return cut(pairs.join(counts, "term")
               .where((gain >= DISCLOSURE * F.log(rows / e)) & (sure >= math.log(max(tested, 1) / LEVEL)))
               .select("term", "th").distinct(), "flagged-terms")


def sanitised_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: k (see ``doc_key``), doc_id, base and spans: (first, kind, last) in order of all.

    kind: the place in ``KINDS``; base holds the spans of the four base kinds.
    """
    found = cut(find(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "entities")
    flagged = flagged_terms(found, docs, text_col)
    more = (places(docs, id_col, text_col, sieve(flagged, "th")).join(flagged.select("term"), "term")
            .groupBy("k").agg(F.collect_set(F.struct("first", F.lit(4).alias("kind"), "last")).alias("more")))
    base = F.transform("base", lambda x: F.struct(x["first"].alias("first"), x["kind"].alias("kind"), x["last"].alias("last")))
    none = F.array().cast("array<struct<first int, kind int, last int>>")
    return found.select("k", "doc_id", base.alias("base")).join(more, "k", "left").select(
        "k", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def told(spans: str) -> Column:
    """Spans as kind:first:last, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["first"], x["last"])))


def replaced(text: str | None, spans: list[dict]) -> str | None:
    """The text with its spans generalised; spans that overlap are one, named for the first."""
    if not text or not spans:
        return text
    out, done = [], 0
    for x in spans:
        if x["first"] >= done:
            kind = KINDS[x["kind"]]
            old = text[x["first"]: x["last"]]
            out += [text[done: x["first"]], "[NUMBER]" if kind == "term" and old.isdigit() else f"[{kind.upper()}]"]
        done = max(done, x["last"])
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, the text sanitised."""
    names = docs.columns
    spans = sanitised_spans(docs, id_col, text_col).where(F.size("spans") > 0).select("k", "spans").dropDuplicates(["k"])
    packed = docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("k"), F.struct(*names).alias("row"),
                         F.col(text_col).alias("text")).join(spans, "k", "left")
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replaced(t, s or []) for t, s in zip(batch.column("text").to_pylist(),
                                                          batch.column("spans").to_pylist(), strict=True)]
            cols = batch.column("row").flatten()
            cols[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return packed.select("row", "text", "spans").mapInArrow(run, docs.schema)
