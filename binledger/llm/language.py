"""Language identification by nearest clustered centroid.

A text is a vector of hashed letter 1-, 2- and 3-grams (lower case, words marked off), weighted by
TF-IDF and normalised. Each language has ``CLUSTERS`` centroids, found by spherical k-means on its labelled
vectors; the nearest by cosine names the language. A text farther from it than nearly all labelled texts of
that language were is marked as rejected.

Fitting uses at most ``FIT_ROWS`` labelled documents a language (those with the smallest hash of their doc_id among about twice as many), a
bounded sample whose bound is a parameter. Documents with crc32(doc_id) mod 4 = 2 are held out:
neither their text nor their lang is learned from. Prediction sees the text alone, the whole of it.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text if nothing
could be learned; equal cosines go to the first language in order; rows without doc_id are predicted, never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binledger.llm.words import map_slices, slices, text_bytes

FIT_ROWS = 500
CLUSTERS = 4
BUCKETS = 1 << 13
#: Share of a language's labelled texts that lie beyond its rejection distance.
REJECT_SHARE = 0.005
UNKNOWN = "und"
_ROWS = 256

#: For each code point of the basic plane: its lower case if it is a letter, else 0.
_LETTER = np.array(
    [ord(low) if chr(i).isalpha() and len(low := chr(i).lower()) == 1 else i * chr(i).isalpha() for i in range(1 << 16)], np.uint32
)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of letters, 0 for a run of anything else, and each one's text; a 0 opens every text."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    b0, b1, b2, b3 = (b[lead + i] for i in range(4))
    x = b0.copy()
    two, three, four = (b0 >= 0xC0) & (b0 < 0xE0), (b0 >= 0xE0) & (b0 < 0xF0), b0 >= 0xF0
    x[two] = (b0[two] & 0x1F) << 6 | b1[two] & 0x3F
    x[three] = (b0[three] & 0x0F) << 12 | (b1[three] & 0x3F) << 6 | b2[three] & 0x3F
    x[four] = (b0[four] & 0x07) << 18 | (b1[four] & 0x3F) << 12 | (b2[four] & 0x3F) << 6 | b3[four] & 0x3F
    if four.any():
        high = np.unique(x[four])
        letter = high[[chr(c).isalpha() for c in high.tolist()]]
        kept = four & np.isin(x, letter)
        x = np.where(four, np.where(kept, x, 0), _LETTER[np.minimum(x, 0xFFFF)])
    else:
        x = _LETTER[x]
    first = np.searchsorted(lead, offsets)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    x, own = np.insert(x, first[:-1], 0), np.insert(own, first[:-1], np.arange(len(offsets) - 1))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (own[1:] != own[:-1])
    return x[keep], own[keep]


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x buckets), and whether each text has a letter."""
    n = len(texts)
    x, own = _letters(*text_bytes(texts))
    out = np.zeros(n * BUCKETS, np.float32)
    has = np.bincount(own[x != 0], minlength=n) > 0 if len(x) else np.zeros(n, bool)
    total = np.zeros(len(x), np.uint32)
    for k, times in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        # the k+1 characters from each place on; a gram begins in its text and holds a letter in its middle
        size = len(x) - k
        if size <= 0:
            break
        total = total[:size] + x[k:] * np.uint32(times)
        middle = x[k // 2 + k % 2 :][:size] if k != 1 else x[:size] | x[1:]
        good = (middle != 0) & (own[:size] == own[k:])
        h = (total[good] ^ np.uint32(k + 1)) * np.uint32(0x27D4EB2F)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x165667B1) >> np.uint32(32 - 13)
        out += np.bincount(own[:size][good] * BUCKETS + h, minlength=n * BUCKETS).astype(np.float32)
    return out.reshape(n, BUCKETS), has


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # clusters x buckets, unit length
    language: np.ndarray  # of each cluster
    nearest: np.ndarray  # least cosine of each language that is not rejected


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a start of mutually far vectors."""
    centre = _unit(x.mean(axis=0, keepdims=True))
    nearest = (x @ centre.T).max(axis=1)
    for _ in range(min(k, len(x)) - 1):
        centre = np.concatenate([centre, x[[int(np.argmin(nearest))]]])
        nearest = np.maximum(nearest, x @ centre[-1])
    for _ in range(rounds):
        member = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([x[member == c].mean(axis=0) if (member == c).any() else centre[c] for c in range(len(centre))])
        centre = _unit(centre)
    return centre


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            for i in range(0, piece.num_rows, _ROWS):
                part = piece.slice(i, _ROWS)
                counts, has = gram_counts(part.column("text"))
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "lang": part.column("lang"),
                    "at": pa.array([a.astype(np.int32).tobytes() for a in at]),
                    "n": pa.array([c[a].tobytes() for c, a in zip(counts, at)]),
                }).filter(pa.array(has))


def fit(documents: DataFrame, fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS) -> Model | None:
    """Centroids of at most ``fit_rows`` labelled documents a language; None if there are none."""
    told = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    told = told.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    # the smallest hashes lie below a share of the range that holds about twice as many rows as are wanted
    counts = told.groupBy("lang").agg(F.count("*").alias("held"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    told = told.withColumn("draw", draw).join(F.broadcast(counts), "lang")  # one row a language
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    chosen = told.where(F.col("draw") * F.col("held") <= 2 * fit_rows).withColumn("n", F.row_number().over(order))
    chosen = chosen.where(F.col("n") <= fit_rows).select("doc_id", "lang").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # at most fit_rows narrow rows a language
        .select("doc_id", "lang", "text")
        .mapInArrow(_features, "doc_id long, lang string, at binary, n binary")
        .toPandas().sort_values(["lang", "doc_id"], kind="stable")
    )
    if rows.empty:
        return None
    seen = np.zeros(BUCKETS)
    for a in rows["at"]:
        seen[np.frombuffer(a, np.int32)] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    languages, centroids, language, nearest = tuple(sorted(rows["lang"].unique())), [], [], []
    for k, name in enumerate(languages):
        own = rows[rows["lang"] == name]
        x = np.zeros((len(own), BUCKETS), np.float32)
        for i, (a, n) in enumerate(zip(own["at"], own["n"])):
            x[i, np.frombuffer(a, np.int32)] = np.frombuffer(n, np.float32)
        x = _vectors(x, idf)
        centre = _clusters(x, clusters)
        centroids.append(centre)
        language += [k] * len(centre)
        nearest.append(float(np.quantile((x @ centre.T).max(axis=1), REJECT_SHARE)))
    return Model(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(language), np.array(nearest))


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred (the nearest language), score (its cosine), rejected (too far from it)."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, far = [], [], []
        for i in range(0, piece.num_rows, _ROWS):
            counts, has = gram_counts(piece.column("text").slice(i, _ROWS))
            if model is None:
                has[:] = False
                cosine, language, nearest = np.zeros((len(has), 1)), np.zeros(1, np.int64), np.ones(1)
            else:
                cosine, language, nearest = _vectors(counts, model.idf) @ model.centroids.T, model.language, model.nearest
            best = np.argmax(cosine, axis=1)
            score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
            names += [model.languages[language[b]] if h else UNKNOWN for b, h in zip(best, has)]
            scores.append(np.where(has, score, 0.0))
            far.append(~has | (score < nearest[language[best]]))
        return pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "lang_pred": pa.array(names, pa.string()),
            "score": pa.array(np.concatenate(scores)), "rejected": pa.array(np.concatenate(far)),
        })

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    return map_slices(rows, "text", work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame) -> DataFrame:
    return predict(documents, fit(documents))
