"""Quality rules: zstandard compression bands.

A document's verdict comes from the ratio of its UTF-8 bytes to their zstandard-compressed size, taken over
the whole text and over fixed chunks of it. Repetitive text compresses too well, random text hardly at all;
which ratios are normal depends on the length, so each length class has a band of its own. The plain rules
(word count, repeated 8-word windows) are reported beside it.

NULL and empty texts have no words and fail the word-count rule. Rows are judged one by one: repeated rows
get equal results. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import per_batch

#: Bytes of a zstd frame besides its content; lower limits hold for the ratio without them.
FRAME = 9
#: (bytes up to, lowest ratio without the frame) for documents and chunks: above random printable and base64 words,
#: below all but 1 in 100 prose texts of the class. Up to 96 bytes zstd shortens prose no better than noise.
LEAST = ((96, 0.0), (112, 1.07), (128, 1.105), (160, 1.125), (192, 1.15), (256, 1.185), (384, 1.23), (512, 1.28), (1024, 1.36),
         (2048, 1.42), (None, 1.50))
#: (bytes up to, highest ratio) for whole documents; the last class has no upper length.
DOC_MOST = ((128, 2.2), (512, 3.2), (2048, 4.0), (8192, 4.5), (None, 5.0))
#: The same for a chunk. A last chunk shorter than 512 bytes is judged with its predecessor.
CHUNK_MOST = ((512, 3.2), (1024, 4.0), (None, 6.0))
CHUNK_BYTES = 4096
#: Share of the text's bytes that may lie in chunks outside their band.
BAD_SHARE = 0.34
ZSTD_LEVEL = 3
MIN_WORDS = 20
WINDOW = 8
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "doc_ratio double, bad_chunk_share double, reason string, base_failed boolean, kept boolean")


def limit(n: int, limits: tuple) -> float:
    """The limit for ``n`` bytes."""
    return next(x for most, x in limits if most is None or n <= most)


def incompressible(n: int, ratio: float) -> bool:
    """Whether ``n`` bytes with this ratio are below the lower limit."""
    return ratio > 0 and n / (n / ratio - FRAME) < limit(n, LEAST)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a ``window``-word sequence found twice or more in the list.

    Window ids are exact: ids of 1, 2, 4, ... words are ranked pairs of the ids before; the window's own id
    pairs two overlapping ids of the largest power below it.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == n:
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        pair = ids[:-step] * n + ids[step:]
        uniq, ids = np.unique(pair, return_inverse=True)
        if len(uniq) == len(pair):
            return 0
        span += step
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def compression(data: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(ratio of the whole, share of the bytes in chunks outside their band)."""
    if not data:
        return 0.0, 0.0
    ratio = len(data) / len(zstd.compress(data))
    at = list(range(0, len(data), CHUNK_BYTES))
    if len(at) > 1 and len(data) - at[-1] < 512:
        at.pop()
    bad = 0
    for a, b in zip(at, [*at[1:], len(data)], strict=True):
        r = (b - a) / len(zstd.compress(data[a:b])) if len(at) > 1 else ratio
        bad += (b - a) * (incompressible(b - a, r) or r > limit(b - a, CHUNK_MOST))
    return ratio, bad / len(data)


def judge(text: str | None, zstd: zstandard.ZstdCompressor) -> tuple:
    """One row of the result without its id."""
    text = text or ""
    data = text.encode()
    words = data.split()  # on the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    ratio, share = compression(data, zstd)
    failed = n < MIN_WORDS or 100 * repeat > 30 * n
    reason = ("words" if n < MIN_WORDS else "repeats" if failed else "incompressible" if incompressible(len(data), ratio)
              else "repetitive" if ratio > limit(len(data), DOC_MOST) else "chunks" if share > BAD_SHARE else None)
    return n, chars, symbols, dup, repeat, ratio, share, reason, failed, reason is None


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base statistics, compression ratios, the reason of a rejection and ``kept``."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        zstd = zstandard.ZstdCompressor(level=ZSTD_LEVEL, write_content_size=False)
        cols = list(zip(*(judge(t, zstd) for t in batch.column("text").to_pylist()), strict=True))
        arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names)

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), fn, SCHEMA)
