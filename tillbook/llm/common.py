"""Helpers the training-data operators share.

Documents are identified by ``doc_key``: the id together with the length and two independent 64-bit hashes
of the text. Rows that agree in id and text are repeats of one document and get one result; rows that share
an id but differ in text (or have a NULL id) stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.session import checkpoint_dir

#: Text bytes handled at once by the vectorised operators (a longer document is one piece of its own).
PIECE_BYTES = 2 << 20
#: Bits of a membership sieve: 2 MB broadcast whatever the input; a fuller sieve only lets more rows pass.
SIEVE_BITS = 1 << 24


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the session's checkpoint folder and read back: a lineage cut.

    Every executor sees the folder, so a lost executor costs no recomputation of what stands before the cut.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(doc_id: Column, text: Column) -> Column:
    """Non-null string that identifies a document by id and text (NULL id or text have keys of their own)."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")),
                       F.coalesce(F.octet_length(text).cast("string"), F.lit("-")),
                       F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")), F.lit("k"))))


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema,
              limit: int = PIECE_BYTES) -> DataFrame:
    """``fn`` over the Arrow batches of ``df``, a bounded piece of text at a time (see ``pieces``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in its column ``text``, or a single row."""
    sizes = np.diff(_offsets(batch.column("text"))).astype(np.int64)
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    if not len(col):
        return np.zeros(1, kind)
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * width)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and the offset of each row (NULL has no bytes)."""
    off = _offsets(col).astype(np.int64)
    data = col.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


_store: dict = {}


def worker_store(owner: tuple, make: Callable[[], object]):
    """What an operator keeps in its Python worker from task to task; that of any other operator or call goes.

    Workers outlive the stages, so a chain of operators holds the largest store only, not the sum of all.
    """
    if _store.get("owner") != owner:
        _store.clear()
        _store.update(value=make(), owner=owner)
    return _store["value"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser for 64-bit hashes: each output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sieve(hashes: DataFrame, column: str, bits: int = SIEVE_BITS) -> np.ndarray:
    """Bitmap of ``hash mod bits`` over a column of longs: at most ``bits / 8`` bytes, for any input.

    The words are combined by ``bit_or`` on the executors, so the driver gets no more than ``bits / 64`` rows.
    """
    slot = F.pmod(F.col(column), F.lit(bits))
    rows = (hashes.select(F.shiftright(slot, 6).cast("int").alias("w"),
                          F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def in_sieve(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) the bitmap holds; may hold more than were put in, never fewer."""
    slot = hashes & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
