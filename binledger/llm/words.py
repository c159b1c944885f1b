"""Words and hashes of many texts at once, as numpy arrays over Arrow buffers.

A word is a longest run of bytes outside space and 0x09-0x0D; in UTF-8 that is
exactly a run of code points outside those six. Everything here works on whole
texts, a few megabytes of them at a time, so memory follows the slice (or the one
longest text), not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of the texts in a slice; word i is ``data[starts[i]:ends[i]]``."""

    data: np.ndarray
    offsets: np.ndarray  # of the texts in data, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (or binaries) and the offsets of each; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    body = texts.buffers()[2]
    if body is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray):
    """Starts and ends of longest runs of bytes not marked in ``outside``; texts part runs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    finish = inside
    finish[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _raise_powers(n: int) -> None:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _STEP | np.uint64(1), np.uint64))


def _hash_long(word: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash of one word longer than a block, block by block."""
    _raise_powers(BLOCK_BYTES)
    low = (1 << 64) - 1
    total, scale, step = 0, 1, int(_powers[BLOCK_BYTES - 1])
    for i in range(0, len(word), BLOCK_BYTES):
        part = table[word[i : i + BLOCK_BYTES]]
        total += scale * int((part * _powers[: len(part)]).sum())
        scale = scale * step & low
    return mix(np.array([(total + len(word) * int(_STEP)) & low], np.uint64))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each run's bytes; ``lower`` takes A-Z as a-z."""
    table, out, i = (_LOWER if lower else _BYTE), np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK_BYTES)))
        lengths = ends[i:j] - starts[i:j]
        if int(lengths.max()) > BLOCK_BYTES:
            if lengths[0] > BLOCK_BYTES:
                out[i : i + 1] = _hash_long(data[starts[i] : ends[i]], table)
                i += 1
                continue
            j = i + int(np.argmax(lengths > BLOCK_BYTES))
            lengths = lengths[: j - i]
        before = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
        _raise_powers(int(lengths.max()))
        at = place + np.repeat(starts[i:j], lengths)
        sums = np.add.reduceat(table[data[at]] * _powers[place], before)
        out[i:j] = mix(sums + lengths.astype(np.uint64) * _STEP)
        i = j
    return out


def find_words(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    data, offsets = text_bytes(texts)
    starts, ends, first = runs(data, offsets, SEPARATOR)
    hashes = hash_runs(data, starts, ends, lower) if hashed else np.zeros(0, np.uint64)
    return Words(data, offsets, starts, ends, first, hashes)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside one text.

    Returns the hash of each window, the index of its first word, and the index of
    each text's first window (one more than texts).
    """
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - before[:-1], counts) + np.arange(int(before[-1]))
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total += hashes[at + i] * _PLACE[i]
    return mix(total + np.uint64(k)), at, before


def text_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets."""
    if not len(values):
        return np.zeros(len(offsets) - 1, values.dtype if values.dtype != bool else np.int64)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` text bytes, one row at least."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32) if len(texts) else np.zeros(1)
    ends = raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, side="right")) - 1)
        yield batch.slice(i, min(j, len(texts)) - i)
        i = j


def bound_batches(spark) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES``, if they are larger.

    The default of 10,000 rows would hold tens of megabytes of texts several times over in every worker.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def map_slices(
    df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str,
    size: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``work`` to pieces of a few megabytes of text, in Arrow batches."""
    bound_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, size):
                made = work(piece)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(each, schema)
