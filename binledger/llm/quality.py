"""Quality rules: base counts and a hashed n-gram logistic regression.

The regression is fitted on labelled rows (``labels.quality``), at most ``FIT_ROWS`` of
them: those with the smallest hash of their doc_id, a bounded sample whose bound is a
parameter. Its inputs are shares of hashed single words, word pairs and character
trigrams of the whole text, so a text's score is three means of weights plus a bias.
One fifth of the sample calibrates the score to a probability (Platt). Documents are
scored in Arrow batches against a fixed threshold.

Defined results: a null or empty text has no words, so it fails the base rules; without
labels, or with labels of one kind only, the model keeps every document that the base rules
keep; repeated rows are judged one by one; null doc_ids are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.llm.words import (
    SEPARATOR, Words, find_words, hash_runs, map_slices, runs, slices, text_sums, windows,
)

FIT_ROWS = 4000
WORD_BUCKETS, PAIR_BUCKETS, GRAM_BUCKETS = 1 << 11, 1 << 11, 1 << 12
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS + GRAM_BUCKETS
#: A document is kept if the probability of good quality is at least this.
KEEP_FROM = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per bucket
    bias: float


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Marks values that occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    marks = np.zeros(len(keys), bool)
    marks[order[1:][same]] = True
    marks[order[:-1][same]] = True
    return marks


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The five counts of every text in a slice."""
    points = ((w.data & 0xC0) != 0x80) & ~SEPARATOR[w.data]
    starts, ends, first = runs(w.data, w.offsets, _NEWLINE)
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    text_of = np.repeat(np.arange(len(w.offsets) - 1), np.diff(first))[has_word]
    lines = hash_runs(w.data, starts[has_word], ends[has_word])
    order = np.lexsort((lines, text_of))
    again = (lines[order][1:] == lines[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    dup_lines = np.bincount(text_of[order][1:][again], minlength=len(w.offsets) - 1)

    triple, at, before = windows(w.hashes, w.first, 3)
    own = np.repeat(np.arange(len(before) - 1, dtype=np.uint64), np.diff(before))
    found = _repeats(triple ^ (own * np.uint64(0xD6E8FEB86659FD93)))
    covered = np.zeros(len(w.hashes), bool)
    for i in range(3):
        covered[at[found] + i] = True
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": text_sums(points, w.offsets).astype(np.int64),
        "n_symbols": text_sums(_SYMBOL[w.data], w.offsets).astype(np.int64),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": text_sums(covered, w.first).astype(np.int64),
    }


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code point begins, and a number for each, the same for the same code point."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    value = data[begin].astype(np.uint32)
    if len(begin) < len(data):
        end = np.append(begin[1:], len(data))
        for k in (1, 2, 3):
            more = np.flatnonzero(end - begin > k)
            value[more] = value[more] << np.uint32(8) | data[begin[more] + k]
    return begin, value


def _inputs(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the bucket of every occurrence, and the offsets of the texts."""
    top = np.uint64(64 - 11)
    pair, _, before = windows(w.hashes, w.first, 2)
    begin, c = _characters(w.data)
    if len(c) > 2:
        gram = c[:-2] + c[1:-1] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA77)
        gram ^= gram >> np.uint32(15)
        gram = (gram * np.uint32(0xC2B2AE3D) >> np.uint32(32 - 12)).astype(np.int32)
    else:
        gram = np.zeros(0, np.int32)
    return [
        ((w.hashes >> top).astype(np.int64), w.first),
        ((pair >> top).astype(np.int64) + WORD_BUCKETS, before),
        (gram + np.int32(WORD_BUCKETS + PAIR_BUCKETS), np.searchsorted(begin, w.offsets)),
    ]


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of ``values[lo:hi]`` for each text by itself, so that it does not depend on the texts beside it."""
    out, some = np.zeros(len(lo)), hi > lo
    if some.any():
        ends = np.stack([lo[some], hi[some]], axis=1).ravel()
        out[some] = np.add.reduceat(np.append(values, 0.0), ends)[::2]
    return out


def _means(w: Words, weights: np.ndarray) -> np.ndarray:
    """Sum over the three kinds of the mean weight of a text's n-grams."""
    out = np.zeros(len(w.offsets) - 1)
    for k, (bucket, offsets) in enumerate(_inputs(w)):
        lo, hi = offsets[:-1], offsets[1:]
        if k == 2:  # trigrams must not reach into the next text
            lo = np.minimum(lo, len(bucket))
            hi = np.clip(hi - 2, lo, len(bucket))
        out += _sums(weights[bucket], lo, hi) / np.maximum(hi - lo, 1)
    return out


def score(w: Words, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_means(w, model.weights) + model.bias, -500, 500)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            for i in range(piece.num_rows):
                w = find_words(piece.column("text").slice(i, 1))
                share = np.zeros(BUCKETS, np.float32)
                for bucket, _ in _inputs(w):
                    if len(bucket):
                        share += np.bincount(bucket, minlength=BUCKETS).astype(np.float32) / len(bucket)
                at = np.flatnonzero(share)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id").slice(i, 1),
                    "quality": piece.column("quality").slice(i, 1),
                    "at": pa.array([at.astype(np.int32).tobytes()]),
                    "share": pa.array([share[at].tobytes()]),
                })


def _descend(x: np.ndarray, y: np.ndarray, steps: int = 250) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the penalised logistic loss, both kinds weighing the same."""
    n, d = x.shape
    weigh = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32) / n
    theta = np.zeros(d + 1, np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -30, 30)))
        slip = (p - y) * weigh
        grad = np.append(x.T @ slip + 1e-3 * theta[:-1], slip.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn a score into a probability (Newton, two parameters)."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Train on at most ``fit_rows`` labelled documents; None if there is nothing to learn."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(fit_rows)
    )
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # at most fit_rows narrow rows
        .select("doc_id", "text", "quality")
        .mapInArrow(_features, "doc_id long, quality int, at binary, share binary")
        .toArrow()
    )
    order = np.lexsort((rows["quality"].to_numpy(), rows["doc_id"].to_numpy()))
    order = np.concatenate([np.delete(order, np.s_[4::5]), order[4::5]])  # a fifth, at the end, is held for calibration
    y = rows["quality"].to_numpy()[order].astype(np.float32)
    if not 0 < y.sum() < len(y):
        return None
    n = len(y) - len(y) // 5
    if not 0 < y[:n].sum() < n:
        n = len(y)
    x = np.zeros((len(y), BUCKETS), np.float32)
    at, share = rows["at"].combine_chunks(), rows["share"].combine_chunks()
    for i, j in enumerate(order.tolist()):
        x[i, np.frombuffer(at[j].as_buffer(), np.int32)] = np.frombuffer(share[j].as_buffer(), np.float32)
    mean = x.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean**2, 0)).astype(np.float32) + np.float32(1e-3)
    x /= spread
    weights, bias = _descend(x[:n], y[:n])
    held = slice(n, None)
    slope, shift = _platt((x[held] @ weights + bias).astype(float), y[held]) if n < len(y) else (1.0, 0.0)
    return Model((slope * weights / spread).astype(np.float64), slope * bias + shift)


def _judged(w: Words, model: Model | None, keep_from: float) -> dict[str, np.ndarray]:
    made = base_counts(w)
    n, repeat = made["n_words"], made["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    p = np.ones(len(n)) if model is None else score(w, model)
    return made | {"base_failed": failed, "kept": ~failed & (p >= keep_from), "p_good": p}


def quality_rules(documents: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, base verdict, probability and verdict of every document."""
    model = fit(documents, labels)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        made = _judged(find_words(piece.column("text")), model, keep_from)
        return pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id")} | {k: pa.array(v) for k, v in made.items()})

    schema = f"doc_id long, {COUNTS}, base_failed boolean, kept boolean, p_good double"
    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), "text", work, schema)


def keep_good(documents: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that pass, with all their columns unchanged."""
    model = fit(documents, labels)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        kept = _judged(find_words(piece.column("text")), model, keep_from)["kept"]
        return piece.filter(pa.array(kept))

    return map_slices(documents, "text", work, documents.schema)
