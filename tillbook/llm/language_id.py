"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum
over all ways to cut it into pieces, by a forward pass over its characters; a text's log-probability is the sum
over its words. The prediction is the language with the highest one; the score is its posterior under equal
priors, with the evidence spread per word so that long texts do not all reach 1.

Learning covers all labelled rows given: words are counted by language (in the tasks first, then by a shuffle),
and each distinct word adds the expected number of uses of each piece over its segmentations, by a forward and
a backward pass under equal piece probabilities by length. The model is bounded by languages times vocabulary.

NULL texts and texts without a letter get ``und`` with score 0; so does every text if nothing was learned.
Ties go to the language first in order. Characters outside the vocabulary cost the same in every language.
Rows are predicted one by one, so repeated rows get equal results. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tillbook.llm.common import cut, per_batch, pieces, worker_store

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
UNKNOWN = "und"
#: Pseudo-count of each piece in each language.
PRIOR = 0.05
#: Words longer than this are passed over one by one, with a window of what the longest piece reaches.
LONG_WORD = 32
#: Distinct words whose scores a worker keeps; beyond that it starts anew.
KEPT_WORDS = 500_000
#: Distinct words a task counts before it hands the counts on.
COUNTED_WORDS = 300_000
#: The evidence of a text counts as that of so many words at most (for the score, not for the prediction).
SCORE_WORDS = 20
WORDS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Lower-case pieces made of letters, numbered; a leading mark of the word's start is dropped."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size())}
    return {p: i for i, p in enumerate(sorted(filter(str.isalpha, found)))}


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The words, those of one length at a time, with the number of each."""
    found: dict[int, tuple[list[int], list[str]]] = {}
    for i, word in enumerate(words):
        at, same = found.setdefault(len(word), ([], []))
        at.append(i)
        same.append(word)
    for at, same in found.values():
        yield np.array(at), same


def longest(vocab: dict[str, int]) -> int:
    return max(map(len, vocab), default=1)


def arcs(words: list[str], vocab: dict[str, int], reach: int) -> list[tuple[int, int, np.ndarray]]:
    """(i, j, piece of each word's characters i to j) for words of one length, where any word has one.

    No piece: ``len(vocab)``; a character that is no piece may still stand alone: ``len(vocab) + 1``.
    """
    n, get, none = len(words[0]), vocab.get, len(vocab)
    out = []
    for i in range(n):
        for j in range(i + 1, min(n, i + reach) + 1):
            ids = [get(w[i:j], none + (j == i + 1)) for w in words]
            if j == i + 1 or min(ids) < none:
                out.append((i, j, np.array(ids)))
    return out


def forward(word: str, vocab: dict[str, int], reach: int, prob: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each end in the word: the sum over all segmentations up to it, as a number of about 1 and its logarithm's rest.

    ``prob`` has a row for each piece (see ``arcs``). Each column is scaled by itself, so no word is too long.
    """
    get, none = vocab.get, len(vocab)
    rest = np.zeros(prob.shape[1])
    window = [np.ones(prob.shape[1])]
    for j in range(1, len(word) + 1):
        now = window[-1] * prob[get(word[j - 1], none + 1)]
        for i in range(max(0, j - reach), j - 1):
            at = get(word[i:j], none)
            if at != none:
                now = now + window[i - j] * prob[at]
        scale = np.maximum(now, 1e-300)
        rest = rest + np.log(scale)
        window = [x / scale for x in window[-reach:]] + [now / scale]
        yield now / scale, rest


def uses_in_long(word: str, vocab: dict[str, int], mirrored: dict[str, int], reach: int, share: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (see ``expected_uses``) in one long word; ``mirrored`` has the pieces spelled backwards."""
    n, get, none = len(word), vocab.get, len(vocab)
    ahead = np.concatenate([[0.0], [float(x[1][0]) for x in forward(word, vocab, reach, share[:, None])]])
    back = np.concatenate([[0.0], [float(x[1][0]) for x in forward(word[::-1], mirrored, reach, share[:, None])]])[::-1]
    out = np.zeros(len(share))
    for i in range(n):
        for j in range(i + 1, min(n, i + reach) + 1):
            at = get(word[i:j], none + (j == i + 1))
            if at != none:
                out[at] += math.exp(ahead[i] + back[j] - back[0]) * share[at]
    return out


def expected_uses(words: list[str], weights: np.ndarray, vocab: dict[str, int]) -> np.ndarray:
    """Expected uses of each piece over the segmentations of the words, each segmentation weighted 8**-pieces."""
    width, reach = len(vocab), longest(vocab)
    share = np.full(width + 2, 0.125)
    share[width] = 0
    out = np.zeros(width + 2)
    mirrored: dict[str, int] = {}
    for at, same in by_length(words):
        n, m = len(same[0]), len(same)
        if n > LONG_WORD:
            mirrored = mirrored or {p[::-1]: i for p, i in vocab.items()}
            for k, word in zip(at, same, strict=True):
                out += weights[k] * uses_in_long(word, vocab, mirrored, reach, share)
            continue
        ahead, back = np.zeros((n + 1, m)), np.zeros((n + 1, m))
        ahead[0] = back[n] = 1
        found = arcs(same, vocab, reach)
        for i, j, ids in found:
            ahead[j] += ahead[i] * share[ids]
        for i, j, ids in reversed(found):
            back[i] += back[j] * share[ids]
        for i, j, ids in found:
            out += np.bincount(ids, weights[at] * ahead[i] * share[ids] * back[j] / back[0], width + 2)
    return out[:width]


class PieceModel:
    """Piece probabilities by language, and the forward pass over words."""

    def __init__(self, langs: list[str], vocab: dict[str, int], counts: np.ndarray):
        smooth = counts + PRIOR
        prob = smooth / smooth.sum(1, keepdims=True)
        alone = prob.min(initial=1.0) * 0.1
        rest = np.array([[0.0], [alone]]).repeat(len(langs), 1)  # no piece; a character on its own
        self.langs, self.vocab, self.prob = langs, vocab, np.concatenate([prob.T.reshape(len(vocab), len(langs)), rest])
        self.forget()

    def __reduce__(self):
        return PieceModel.of, (self.langs, self.vocab, self.prob)

    @classmethod
    def of(cls, langs: list[str], vocab: dict[str, int], prob: np.ndarray) -> PieceModel:
        """The model with the probabilities given, without its store of word scores."""
        model = cls.__new__(cls)
        model.langs, model.vocab, model.prob = langs, vocab, prob
        model.forget()
        return model

    def forget(self, room: int = 0) -> None:
        """Start the store of word scores anew."""
        self.kept: dict[str, int] = {}
        self.reach = longest(self.vocab)
        self.rows = np.empty((max(KEPT_WORDS, room), len(self.langs)))

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, summed over all its segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        for at, same in by_length(words):
            if len(same[0]) > LONG_WORD:
                for k, word in zip(at, same, strict=True):
                    *_, (_, out[k]) = forward(word, self.vocab, self.reach, self.prob)
                continue
            ahead = np.zeros((len(same[0]) + 1, len(same), len(self.langs)))
            ahead[0] = 1
            for i, j, ids in arcs(same, self.vocab, self.reach):
                ahead[j] += ahead[i] * self.prob[ids]
            out[at] = np.log(np.maximum(ahead[-1], 1e-300))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        new = set().union(*split).difference(self.kept)
        if len(self.kept) + len(new) > len(self.rows):
            new = set().union(*split)
            self.forget(len(new))
        if new and self.langs:
            new, known = list(new), len(self.kept)
            self.rows[known: known + len(new)] = self.log_words(new)
            self.kept.update(zip(new, range(known, known + len(new)), strict=True))
        langs, scores = [], []
        for ws in split:
            if not self.langs or not any(c.isalpha() for w in ws for c in w):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            log = self.rows[list(map(self.kept.__getitem__, ws))].sum(0)
            best = int(log.argmax())
            near = np.exp((log - log[best]) * min(1.0, SCORE_WORDS / len(ws)))
            langs.append(self.langs[best])
            scores.append(float(1 / near.sum()))
        return langs, scores


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (text, lang): counted in the tasks, then summed by a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()),
                     pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for piece in pieces(batch):
                for text, lang in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist(), strict=True):
                    counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > COUNTED_WORDS:
                    yield from out()
        yield from out()

    rows = labelled.mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, path: str = VOCABULARY) -> PieceModel:
    """The model of all rows of (text, lang) whose lang is not NULL."""
    vocab = vocabulary(path)
    width = len(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, words, n = batch.column("lang"), batch.column("word"), batch.column("n")
            for lang in langs.unique():
                here = pc.equal(langs, lang)
                uses = expected_uses(words.filter(here).to_pylist(), n.filter(here).to_numpy().astype(float), vocab)
                total[lang.as_py()] = total.get(lang.as_py(), 0) + uses
        for lang, row in total.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(row[used])],
                ["lang", "piece", "uses"])

    counts = cut(word_counts(labelled.select("text", "lang").where("lang is not null")), "language-words")
    # one row per language and piece: bounded by the languages and the vocabulary, whatever the corpus.
    # rounded, so that the order in which tasks are added up does not show
    uses = (counts.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, uses double")
            .groupBy("lang", "piece").agg(F.round(F.sum("uses"), 4).alias("uses")).toArrow())
    langs = sorted(set(uses.column("lang").to_pylist()))
    table = np.zeros((len(langs), width))
    where = {x: i for i, x in enumerate(langs)}
    rows = np.array([where[x] for x in uses.column("lang").to_pylist()], np.int64)
    table[rows, uses.column("piece").to_numpy().astype(np.int64)] = uses.column("uses").to_numpy()
    return PieceModel(langs, vocab, table)


def with_language(docs: DataFrame, labelled: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(row, lang_pred, score), one per input row, all its columns in ``row``; learned from ``labelled`` (text, lang)."""
    model = learn(labelled, path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tag = uuid.uuid4().hex

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        # the broadcast model with the worker's own store of word scores
        langs, scores = worker_store(("language", tag), lambda: shared.value).predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            ["row", "lang_pred", "score"])

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    kinds = StructType([packed.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return per_batch(packed, fn, kinds)


def language_id(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                path: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, lang_pred and score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_language(rows, labelled, "text", path).select("row.doc_id", "lang_pred", "score")
