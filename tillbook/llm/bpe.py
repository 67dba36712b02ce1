"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a piece of text go into a trie. Walking it depth first, each node gets its *state*: the
last token of the encoding of the symbols from the root to the node. The state of a node follows from those
of its ancestors: it is the one token that ends here, encodes to itself, and may follow the state of the node
where it begins (two tokens may follow each other when encoding their joined symbols gives just these two).
So the encoding of a prefix that many words share is computed once. Going back from a word's last node, token
by token, spells its encoding.

The vocabulary file is that of the ``tokenizers`` library (BPE with an end-of-word suffix). Normalisation
(NFC, white space, lower case), the split pattern and the special tokens are read from it. NULL text is
treated as empty; an empty text has no tokens. Rows are handled one by one, so repeated rows get equal results.
Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillbook.llm.common import per_batch, worker_store

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Encoded words a worker keeps; beyond that it starts anew.
KEPT_WORDS = 400_000
#: Lower-case texts of these characters only are split by PLAIN_WORDS, the file's pattern for these characters.
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e¡«»¿ß-öø-ÿ]*")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class TrieBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.cutter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.rules = Tokenizer.from_file(path)
        self.table = dict(enumerate(byte_symbols()))
        self.back = {ord(s): b for b, s in self.table.items()}
        self.longest = max(len(t) - len(self.suffix) * t.endswith(self.suffix) for t in self.vocab)
        self.parts = {a + b: (a, b) for a, b in reversed(self.ranks)}  # of each token, its first merge
        self.made = {t: self.ranks[p] for t, p in self.parts.items()}
        self.follows: dict[tuple[str, str], bool] = {}
        #: the tokens whose symbols encode to the token itself
        self.standing = {t: i for t, i in self.vocab.items() if self.merged(self.symbols(t)) == [t]}
        self.kept: dict[str, bytes] = {}

    # --- what the traversal rests on

    def symbols(self, token: str) -> list[str]:
        """A token's characters; the end-of-word mark belongs to the last one."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The merges applied by rank to the symbols of one token."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the symbols of both tokens together encode to just these two.

        The merges that made the tokens are undone, latest first. What then stands at the border must not
        have been joined before the merge undone last; of equal merges the one further left goes first.
        """
        got = self.follows.get((left, right))
        if got is not None:
            return got
        if len(self.follows) > 1 << 18:
            self.follows.clear()
        key, limit = (left, right), len(self.ranks)
        while True:
            if self.ranks.get((left, right), limit) < limit:
                got = False
                break
            made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
            if made_left < 0 and made_right < 0:
                got = True
                break
            if made_left > made_right:
                limit, left = made_left, self.parts[left][1]
            else:
                limit, right = made_right + 1, self.parts[right][0]
        self.follows[key] = got
        return got

    # --- the traversal

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct non-empty words."""
        root: dict = {}
        for w in words:
            node = root
            body = w.encode().decode("latin-1").translate(self.table)
            for s in body[:-1]:
                node = node.setdefault(s, {})
            # the last symbol carries the end-of-word mark, so it never leads on to a longer word
            node[body[-1] + self.suffix] = w
        out: dict[str, bytes] = {}
        states: list[tuple[int, int, str]] = [(0, -1, "")]  # by depth: where the last token begins, its id and text
        stack = [(1, s, child) for s, child in root.items()]
        while stack:
            depth, prefix, child = stack.pop()
            del states[depth:]
            states.append(self.last_token(prefix, depth, states))
            if type(child) is dict:
                depth += 1
                stack += [(depth, prefix + s, below) for s, below in child.items()]
            else:
                ids = []
                while depth:
                    depth, i, _ = states[depth]
                    ids.append(i)
                out[child] = array("I", ids[::-1]).tobytes()
        return out

    def last_token(self, prefix: str, depth: int, states: list[tuple[int, int, str]]) -> tuple[int, int, str]:
        """The token that ends the encoding of a prefix of ``depth`` symbols, given the states before it."""
        for at in range(max(0, depth - self.longest), depth):
            token = prefix[at:]
            i = self.standing.get(token)
            if i is not None:
                before = states[at]
                if not at or self.may_follow(before[2], token):
                    return at, i, token
        raise ValueError(f"no token ends {prefix!r}")

    # --- whole texts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pre_tokens(t or "") for t in texts]
        words = set().union(*split)
        new = words.difference(self.kept)
        if new:
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept, new = {}, words
            special = {w for w in new if w in self.special}
            self.kept |= {w: np.array([self.special[w]], "<u4").tobytes() for w in special}
            self.kept |= self.encode_words([w for w in new if w not in special])
        get = self.kept.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def pre_tokens(self, text: str) -> list[str]:
        """The words of a text; special tokens stay whole (no word has letters beside other signs)."""
        if "<|" not in text:
            return self.words_of(text)
        out: list[str] = []
        for i, part in enumerate(self.cutter.split(text)):
            out += [part] if i % 2 else self.words_of(part)
        return out

    def words_of(self, text: str) -> list[str]:
        """Normalised and split; texts with characters beyond ``PLAIN`` by the vocabulary file's own rules."""
        lower = text.lower()
        if PLAIN.fullmatch(lower):
            return PLAIN_WORDS.findall(lower)
        rules = self.rules
        split = rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))
        return [w.translate(self.back).encode("latin-1").decode() for w, _ in split]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, spaced: what the vocabulary's own decoder gives, special tokens included."""
        return " ".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer(path: str) -> TrieBPE:
    return worker_store(("bpe", path), lambda: TrieBPE(path))


def bpe_round(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens and the decoded text."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        ids = bpe.encode(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
             pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                     fn, "doc_id long, ids binary, n_tokens long, decoded string")
