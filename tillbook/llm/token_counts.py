"""Token counts that follow edits.

A document's state is its text and a segment tree: a leaf holds the characters and tokens of ``LEAF`` consecutive
pre-tokens, an inner node the sums of the two below. An edit (position, characters deleted, text inserted) goes
down the tree to the leaf it begins in. From a boundary before it that the edit can't have moved, the old and the
new text are cut into pre-tokens side by side until they share a boundary beyond the edit; what follows can't have
changed, as the cutting only looks ahead. Only the pre-tokens between are encoded, and only the sums above the
leaves they lie in are updated. So edits cost what they touch, not the length of the text.

``count_tokens`` makes the states, ``apply_edits`` brings them up to date and can be called again on its result.

Edits come as a table (doc_id, edit, at, deleted, inserted), applied in the order of ``edit`` (then of at,
deleted, inserted); positions count the characters of the text as the edits before have left it, and are brought
inside it. A NULL edit number is the first, NULL at or deleted is 0, NULL inserted is empty. NULL text is empty.
Edits of an id apply to all rows with that id; edits without a document, or with a NULL id, apply to none. The
edits of one document build on one another and are one task's work; they spread over documents. Repeated rows get
equal results. Extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import per_batch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
#: How far beyond its end the cutting of a pre-token looks: white space leaves its last character to the next
#: word, and a mark of contraction looks at two letters.
LOOKS = 3
#: Pre-tokens in a leaf when a tree is made.
LEAF = 64
#: Pre-tokens whose counts a worker keeps.
KEPT = 300_000
STATE = "doc_id long, text string, chars array<int>, tokens array<int>, n_tokens long"


class Counter:
    """Tokens of single pre-tokens, each counted once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # the pattern takes each text whole: what it is given is a pre-token
        self.encoding = tiktoken.Encoding("pre-tokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.kept: dict[str, int] = {}

    def count(self, pre: list[str]) -> list[int]:
        new = set(pre).difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.kept, new = {}, set(pre)
        for p in new:
            self.kept[p] = len(self.encoding.encode_ordinary(p))
        return list(map(self.kept.__getitem__, pre))


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """Segment tree over the leaves' characters and tokens: node i has the children 2i and 2i + 1."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], count: Counter):
        self.text, self.count, self.leaves = text, count, max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        spare = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + spare, [0] * self.size + tokens + spare
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded = 0

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds the character at ``pos`` (the last one beyond the end), and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if pos >= begin + self.chars[i] and (self.chars[i + 1] or begin + self.chars[i] < pos):
                begin += self.chars[i]
                i += 1
        return i, begin

    def add(self, leaf: int, chars: int, tokens: int) -> None:
        """Updates the sums from a leaf to the root."""
        while leaf:
            self.chars[leaf] += chars
            self.tokens[leaf] += tokens
            leaf //= 2

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        old = self.text
        at = min(max(at, 0), len(old))
        end = min(at + max(deleted, 0), len(old))
        new = self.text = old[:at] + inserted + old[end:]
        shift = len(new) - len(old)

        leaf, begin = self.leaf_at(max(0, at - LOOKS))
        first = min(begin, max(0, at - LOOKS))
        for m in PATTERN.finditer(old, first):  # boundary context: cut, not encoded
            if m.end() > at - LOOKS:
                break
            first = m.end()
        was, now = PATTERN.finditer(old, first), PATTERN.finditer(new, first)
        gone: list[tuple[int, str]] = []
        come: list[str] = []
        p = q = first  # boundaries reached in the old and in the new text
        while p < end or p + shift != q:
            if p + shift <= q and p < len(old) or q == len(new):
                m = next(was)
                gone.append((p, m[0]))
                p = m.end()
            else:
                m = next(now)
                come.append(m[0])
                q = m.end()

        counts = self.count.count([*(t for _, t in gone), *come])
        self.encoded += len(come)
        places = []
        stop = begin + self.chars[leaf]
        home = leaf
        for pos, _ in gone:
            while pos >= stop and leaf < self.size + self.leaves - 1:
                leaf += 1
                stop += self.chars[leaf]
            places.append(leaf)
        for leaf, (_, t), n in zip(places, gone, counts, strict=False):
            self.add(leaf, -len(t), -n)
        self.add(home, sum(map(len, come)), sum(counts[len(gone):]))

    def state(self) -> tuple[str, list[int], list[int], int]:
        used = slice(self.size, self.size + self.leaves)
        return self.text, self.chars[used], self.tokens[used], self.tokens[1]


def _batch(doc_ids: pa.Array, states: list[tuple], **more: list[int]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
    cols = list(zip(*states, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [doc_ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(pa.array(v, pa.int64()) for v in more.values())],
        ["doc_id", "text", "chars", "tokens", "n_tokens", *more])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """The state of each row: doc_id, text, chars and tokens of the leaves, n_tokens."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        states = []
        for text in batch.column("text").to_pylist():
            pre = PATTERN.findall(text or "")
            n, size = counter(path).count(pre), list(map(len, pre))
            at = range(0, len(pre), LEAF)
            states.append((text or "", [sum(size[i: i + LEAF]) for i in at], [sum(n[i: i + LEAF]) for i in at], sum(n)))
        return _batch(batch.column("doc_id"), states)

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), fn, STATE)


def apply_edits(states: DataFrame, edits: DataFrame, path: str = RANKS) -> DataFrame:
    """The states after the edits, with n_before (tokens), n_edits and n_encoded (pre-tokens encoded for them)."""
    each = edits.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(
        F.col("edit").cast("long").alias("edit"), F.coalesce(F.col("at"), F.lit(0)).cast("long").alias("at"),
        F.coalesce(F.col("deleted"), F.lit(0)).cast("long").alias("deleted"),
        F.coalesce(F.col("inserted"), F.lit("")).alias("inserted")).alias("e"))
    by_doc = each.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("edits"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        states, before, n_edits, encoded = [], [], [], []
        rows = (batch.column(c).to_pylist() for c in ("text", "chars", "tokens", "n_tokens", "edits"))
        for text, chars, tokens, n, todo in zip(*rows, strict=True):
            tree = Tree(text, chars, tokens, counter(path)) if todo else None
            for e in todo or []:
                tree.edit(e["at"], e["deleted"], e["inserted"])
            states.append(tree.state() if tree else (text, chars, tokens, n))
            before.append(n)
            n_edits.append(len(todo or []))
            encoded.append(tree.encoded if tree else 0)
        return _batch(batch.column("doc_id"), states, n_before=before, n_edits=n_edits, n_encoded=encoded)

    rows = states.select("doc_id", "text", "chars", "tokens", "n_tokens").join(by_doc, "doc_id", "left")
    return per_batch(rows, fn, f"{STATE}, n_before long, n_edits long, n_encoded long")
