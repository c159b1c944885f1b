"""Periodic runs of words by a sparse diagonal scan.

A cell (position, lag) says that a stretch of words recurs ``lag`` words earlier. Cells of one lag that follow
each other are a diagonal, whose match length grows with every cell; where a diagonal ends with
enough matches, its run is emitted. A run of period q and length L is a diagonal of lag q with L - q matches.

Only cells that can lie on a sufficient diagonal are made, or a frequent word would meet all its earlier
occurrences. A run of at least 24 words and three periods has 16 matches, or 2q where q > 8. So a position is
looked up by its window of W words, W = 16 for q <= 16 and the power of two in [q, 2q) beyond, and meets the
*latest* earlier occurrence of that window. This loses nothing: if every window of W words inside a stretch
of 2q words of the run had a period of W/2 or less, neighbouring windows would share it and the run had a
smaller period than q; so one window has not, its occurrences are more than W/2 >= q/2 apart, and the one before it is q
words earlier. Diagonals are then extended word by word to both ends. Work is n log n in the words of a text, also
for a text of one word repeated.

Defined results: a null or empty text has no words and no runs; a null doc_id has no checksum, so its words stay as
they are; repeated rows are judged one by one; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.llm.words import Words, find_words, map_slices, mix

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Matches that every run of MIN_LENGTH words and MIN_PERIODS periods has at the lag of its period.
SEED = 16
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of ``2 * size`` items from those of ``size``; the last windows are missing."""
    if len(hashes) <= size:
        return hashes[:0]
    return mix(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[size:] + np.uint64(size)))


def _cells(hashes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags of windows whose latest earlier occurrence is ``low`` to ``high`` words before."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    at, lag = order[1:][same], (order[1:] - order[:-1])[same]
    near = (lag >= low) & (lag <= high)
    return at[near], lag[near]


def _matches(words: np.ndarray, at: int, lag: int, step: int, stop: int) -> int:
    """How many words from ``at`` on, going by ``step`` (1 or -1) up to ``stop``, equal those ``lag`` before."""
    found, size = 0, 64
    while at != stop:
        n = min(size, abs(stop - at))
        lo, hi = (at, at + n) if step > 0 else (at - n + 1, at + 1)
        other = np.flatnonzero(words[lo:hi] != words[lo - lag : hi - lag])
        if len(other):
            return found + int(other[0] if step > 0 else n - 1 - other[-1])
        found, at, size = found + n, at + step * n, size * 2
    return found


def _is_primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether no proper divisor of ``period`` is a period of the run that starts at ``start``."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            d = period // factor
            if np.array_equal(words[start : start + period], words[start + d : start + d + period]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def find_runs(words: np.ndarray) -> list[Run]:
    """All maximal runs in one text, given a hash of each word, by start, then period."""
    n, size, windows, out = len(words), 1, words, []
    if n < MIN_LENGTH:
        return out
    while size < SEED:
        windows, size = _doubled(windows, size), 2 * size
    while size == SEED or size // 2 < n // MIN_PERIODS:
        at, lag = _cells(windows, 1 if size == SEED else size // 2 + 1, min(size, n // MIN_PERIODS))
        if size == SEED and not len(at) and len(np.unique(windows)) == len(windows):
            break  # without a repeated seed there is no longer one either
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.ones(len(at), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + size)
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        done_lag, done_end = 0, 0
        for begin, end, q in zip(at[heads].tolist(), (at[tails] + size).tolist(), lag[heads].tolist()):
            if q == done_lag and begin < done_end:
                continue  # on a diagonal that was followed to its end already
            begin -= _matches(words, begin - 1, q, -1, q - 1)
            end += _matches(words, end, q, 1, n)
            done_lag, done_end = q, end
            run = Run(begin - q, end - begin + q, q)
            if run.length >= max(MIN_LENGTH, MIN_PERIODS * q) and _is_primitive(words, run.start, q):
                out.append(run)
        windows, size = _doubled(windows, size), 2 * size
    return sorted(out, key=lambda r: (r.start, r.period))


def tailed_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers of the text that the report is about, where they differ from 0 to n - 1.

    One document in ten, by the checksum of its number, has its tail from word ``a`` on replaced by repeats of ``p`` words.
    """
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Marks the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge[:-1]) == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length over period; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def repeated_seed(w: Words) -> np.ndarray:
    """Marks the texts of a slice in which some window of SEED words occurs twice."""
    found = np.zeros(len(w.counts), bool)
    hashes, size = w.hashes, 1
    while size < SEED:
        hashes, size = _doubled(hashes, size), 2 * size
    text = np.repeat(np.arange(len(w.counts), dtype=np.uint64), w.counts)
    inside = text[: len(hashes)] == text[SEED - 1 :] if len(hashes) else np.zeros(0, bool)
    own = text[: len(hashes)][inside]
    hashes = mix(hashes[inside] ^ own * _SPREAD)
    order = np.argsort(hashes)
    found[own[order[1:]][hashes[order[1:]] == hashes[order[:-1]]].astype(np.int64)] = True
    return found


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _report(piece: pa.RecordBatch, tailed: bool) -> pa.RecordBatch:
    w = find_words(piece.column("text"))
    ids, repeated = piece.column("doc_id").to_pylist(), repeated_seed(w)
    rows = []
    for i, doc_id in enumerate(ids):
        body = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()
        order = tailed_order(doc_id, len(body)) if tailed else None
        runs = []
        if order is not None:
            runs = find_runs(w.hashes[w.first[i] : w.first[i + 1]][order])
            body = [body[j] for j in order.tolist()]
        elif repeated[i]:
            runs = find_runs(w.hashes[w.first[i] : w.first[i + 1]])
        if runs:
            body = [body[j] for j in np.flatnonzero(kept_words(len(body), runs)).tolist()]
        best = strongest(runs)
        rows.append((
            doc_id, len(runs),
            *((best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4),
            _sha("".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()), _sha(b" ".join(body)),
        ))
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def run_report(documents: DataFrame, tailed: bool = False) -> DataFrame:
    """Per document: number of runs, the strongest run, and digests of all runs and of the text without repeats.

    ``tailed`` first gives the documents that ``tailed_order`` names their repeated tails.
    """
    return map_slices(
        documents.select(F.col("doc_id").cast("long"), "text"), "text", lambda piece: _report(piece, tailed), SCHEMA
    )


def _listed(piece: pa.RecordBatch) -> pa.RecordBatch:
    w = find_words(piece.column("text"))
    rows, texts = [], []
    for i in np.flatnonzero(repeated_seed(w)).tolist():
        found = find_runs(w.hashes[w.first[i] : w.first[i + 1]])
        rows += found
        texts += [i] * len(found)
    made = np.array(rows, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays(
        [piece.column("doc_id").take(pa.array(texts, pa.int64())), *(pa.array(made[:, k]) for k in range(3))],
        ["doc_id", "start", "length", "period"],
    )


def list_runs(documents: DataFrame) -> DataFrame:
    """A row per run of every document: first word, words, period."""
    wanted = documents.select(F.col("doc_id").cast("long"), "text")
    return map_slices(wanted, "text", _listed, "doc_id long, start long, length long, period long")


def _collapsed(piece: pa.RecordBatch) -> pa.RecordBatch:
    w = find_words(piece.column("text"))
    made = piece.column("text").to_pylist()
    for i in np.flatnonzero(repeated_seed(w)).tolist():
        runs = find_runs(w.hashes[w.first[i] : w.first[i + 1]])
        if runs:
            body = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()
            keep = np.flatnonzero(kept_words(len(body), runs)).tolist()
            made[i] = b" ".join([body[j] for j in keep]).decode()
    at = piece.schema.get_field_index("text")
    return piece.set_column(at, piece.schema.field(at), pa.array(made, piece.column("text").type))


def collapse_runs(documents: DataFrame) -> DataFrame:
    """The documents with every run cut to its first period; texts without runs stay as they are."""
    return map_slices(documents, "text", _collapsed, documents.schema)


#: The same in SQL, for small tables: all earlier occurrences of SEED-word windows, as islands on their diagonals.
CHECK_SQL = r"""
WITH bits AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text,
         list_transform(range(8 * len(doc_id::VARCHAR)),
                        lambda k: ((ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) >> (k % 8)::INT) & 1)::UBIGINT) AS b
  FROM documents),
summed AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, b),
                         lambda c, x: xor(c >> 1, CASE WHEN (xor(c, x) & 1) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)),
             4294967295::UBIGINT)::BIGINT AS h
  FROM bits),
texts AS MATERIALIZED (
  SELECT doc_id, len(words) AS n,
         CASE WHEN h % 10 <> 0 OR len(words) = 0 THEN words
              ELSE list_transform(range(len(words)), lambda i: words[1 + CASE
                WHEN i < (h // 10) % len(words) THEN i
                ELSE (h // 10) % len(words) + (i - (h // 10) % len(words))
                     % (1 + (len(words) - (h // 10) % len(words)) // (3 + (h // 10) % 8)) END]) END AS words
  FROM summed),
grams AS MATERIALIZED (
  SELECT doc_id, n, i, md5(array_to_string(words[i + 1 : i + 16], ' ')) AS g
  FROM (SELECT doc_id, n, words, unnest(range(n - 15)) AS i FROM texts WHERE n >= 24)),
cells AS (
  SELECT a.doc_id, a.i, a.i - b.i AS lag FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g
  WHERE a.i > b.i AND 3 * (a.i - b.i) <= a.n),
islands AS (
  SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM cells),
stretches AS MATERIALIZED (
  SELECT doc_id, min(i) - lag AS start, count(*) + 15 + lag AS length, lag AS period
  FROM islands GROUP BY doc_id, lag, island
  HAVING count(*) + 15 + lag >= greatest(24, 3 * lag)),
runs AS MATERIALIZED (
  SELECT * FROM stretches r WHERE NOT EXISTS (
    SELECT 1 FROM stretches s WHERE s.doc_id = r.doc_id AND s.period < r.period
      AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
per_text AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs s WHERE s.doc_id = r.doc_id AND (s.length * r.period > r.length * s.period
      OR (s.length * r.period = r.length * s.period AND (s.start < r.start OR (s.start = r.start AND s.period < r.period)))))),
held AS (
  SELECT t.doc_id, t.i, t.word FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(words) AS word FROM texts) t
  WHERE NOT EXISTS (
    SELECT 1 FROM runs r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length)),
collapsed AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM held GROUP BY doc_id)
SELECT t.doc_id, coalesce(p.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(p.listed, '')) AS runs_sha256, sha256(coalesce(c.body, '')) AS collapsed_sha256
FROM texts t LEFT JOIN per_text p ON t.doc_id = p.doc_id LEFT JOIN best b ON t.doc_id = b.doc_id
LEFT JOIN collapsed c ON t.doc_id = c.doc_id"""
