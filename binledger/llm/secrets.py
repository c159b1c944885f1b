"""Secret scan: fixed patterns, and a randomness battery with false-discovery control.

**Base spans** come from three patterns (assign, access, hex). **Random spans** come from a battery on
tokens: longest runs of ``[A-Za-z0-9+/_-]`` of ``MIN_TOKEN`` bytes or more with a digit and a letter.
The smallest alphabet that holds a token is its inferred encoding; in that encoding three tests ask
whether it looks drawn at random: chi-squared uniformity over the alphabet, runs above and
below its middle, and lag-one serial correlation. Their p-values are combined (three times the smallest).

A token is taken for a secret if that p reaches the threshold of its encoding and length band.
Short tokens give weak tests, so thresholds are set per band: over *all* documents the p-values of a band are
counted; random tokens spread evenly over (0, 1), structured ones pile up near 0, so the upper half
tells how many are random, and the threshold is the least one at which the estimated share of
structured tokens among those taken is at most ``FALSE_SHARE``. Bands of few tokens are pooled with their
neighbours, and where no threshold does, nothing is taken. The counts are a table of fixed size.

Defined results: a null text is empty; a row without spans has zero counts, the digest of the empty string
and empty ``spans``; repeated rows and null doc_ids are judged row by row. Whole texts are scanned.
Random spans that overlap a base span are left out: the base span stands for them.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.llm.words import map_slices, runs, text_bytes

KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 20
FALSE_SHARE = 0.05
#: Upper ends of the length bands; longer tokens form the last band.
BANDS = (24, 32, 40, 64, 128)
P_BINS = 40
#: Bands with fewer tokens than this share their threshold with neighbours.
MIN_POOL = 100

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
#: Encodings from the smallest alphabet to the largest; the first that holds a token is inferred.
ENCODINGS = {
    "hex": _DIGITS + b"abcdef",
    "HEX": _DIGITS + b"ABCDEF",
    "base32": _UPPER + b"234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + b"+/",
    "base64url": _UPPER + _LOWER + _DIGITS + b"-_",
}


def _outside(inside: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(inside)] = False
    return table


_NOT_HEX = _outside(ENCODINGS["hex"])
_NOT_TOKEN = _outside(_UPPER + _LOWER + _DIGITS + b"+/_-")
_IS_DIGIT, _IS_LETTER = ~_outside(_DIGITS), ~_outside(_UPPER + _LOWER)
_CODES = []
for _alphabet in ENCODINGS.values():
    _codes = np.full(256, -1, np.int16)
    _codes[list(_alphabet)] = np.arange(len(_alphabet))
    _CODES.append((_codes, len(_alphabet)))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: np.ndarray) -> tuple[int, float] | None:
    """Index of the inferred encoding and the combined p-value of "drawn at random"; None if no encoding holds it."""
    for which, (codes, size) in enumerate(_CODES):
        c = codes[token]
        if c.min() >= 0:
            break
    else:
        return None
    n = len(c)
    seen = np.bincount(c, minlength=size).astype(float)
    chi = ((seen - n / size) ** 2).sum() * size / n
    uniform = 0.5 * math.erfc((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n) / math.sqrt(2))
    high = c * 2 >= size
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        in_runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / spread)
    else:
        in_runs = 2.0 ** (1 - n)
    x = c - c.mean()
    total = float((x * x).sum())
    serial = _two_sided(((x[1:] * x[:-1]).sum() / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return which, min(1.0, 3 * min(uniform, in_runs, serial))


def band_of(length: int) -> int:
    return int(np.searchsorted(BANDS, length))


def _base(data: bytes) -> list[tuple[int, int, int]]:
    found = []
    if b"=" in data or b":" in data:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 18]
    return found


def _overlapped(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the tokens share a byte with a span."""
    if not spans:
        return np.zeros(len(starts), bool)
    spans = np.array(sorted(spans))
    before = np.searchsorted(spans[:, 0], ends)  # spans that begin before the token ends
    reach = np.concatenate([[-1], np.maximum.accumulate(spans[:, 1])])
    return reach[before] > starts


def _scan(texts: pa.Array):
    """For each text of a slice: base spans, and tokens with battery results, all in bytes of the slice."""
    data, offsets = text_bytes(texts)
    base: list[list[tuple[int, int, int]]] = []
    for i in range(len(texts)):
        lo = int(offsets[i])
        base.append([(lo + s, kind, lo + e) for s, kind, e in _base(data[lo : offsets[i + 1]].tobytes())])
    for outside, least, kind in ((_NOT_HEX, 16, 2), (_NOT_TOKEN, MIN_TOKEN, 3)):
        starts, ends, _ = runs(data, offsets, outside)
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        if kind == 2:
            for i, s, e in zip(text_of.tolist(), starts.tolist(), ends.tolist()):
                base[i].append((s, 2, e))
    tokens: list[list[tuple[int, int, int, float]]] = [[] for _ in base]
    free = ~_overlapped(starts, ends, [(s, e) for spans in base for s, _, e in spans])
    for i, s, e in zip(text_of[free].tolist(), starts[free].tolist(), ends[free].tolist()):
        token = data[s:e]
        if not (_IS_DIGIT[token].any() and _IS_LETTER[token].any()):
            continue
        if (told := battery(token)) is not None:
            tokens[i].append((s, e, told[0] * (len(BANDS) + 1) + band_of(e - s), told[1]))
    return data, offsets, base, tokens


def token_counts(documents: DataFrame) -> np.ndarray:
    """Tokens by (encoding and length band, bin of p), counted over all documents."""
    groups = len(ENCODINGS) * (len(BANDS) + 1)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros(groups * P_BINS, np.int64)
        for tokens in _scan(piece.column("text"))[3]:
            for _, _, group, p in tokens:
                counts[group * P_BINS + min(P_BINS - 1, int(p * P_BINS))] += 1
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_pydict({"cell": pa.array(at.astype(np.int64)), "n": pa.array(counts[at])})

    cells = map_slices(documents.select("text"), "text", work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(groups * P_BINS, np.int64)
    for cell, n in cells.collect():  # at most groups x bins rows
        out[cell] = n
    return out.reshape(groups, P_BINS)


def _pools(counts: np.ndarray, least: int = MIN_POOL) -> list[list[int]]:
    """Neighbouring length bands of an encoding, together until they hold ``least`` tokens; encodings that never do are one pool."""
    bands, pools, rest = len(BANDS) + 1, [], []
    sizes = counts.sum(axis=1)
    for first in range(0, len(counts), bands):
        own: list[list[int]] = [[]]
        for group in range(first, first + bands):
            own[-1].append(group)
            if sizes[own[-1]].sum() >= least:
                own.append([])
        short = own.pop()
        if own:
            own[-1] += short
            pools += own
        else:
            rest += short
    return pools + [rest] if rest else pools


def thresholds(counts: np.ndarray, false_share: float = FALSE_SHARE) -> np.ndarray:
    """The least p taken for random, for each encoding and length band; above 1 where none is taken.

    One is added to the estimated number of structured tokens, so that a handful of tokens decides nothing.
    """
    out = np.full(len(counts), 2.0)
    for pool in _pools(counts):
        row = counts[pool].sum(axis=0)
        random = 2.0 * row[P_BINS // 2 :].sum()
        for b in range(P_BINS // 2 + 1):
            taken = row[b:].sum()
            if 1 + max(0.0, taken - random * (1 - b / P_BINS)) <= false_share * taken:
                out[pool] = max(b / P_BINS, 1e-3)
                break
    return out


def _found(texts: pa.Array, least: np.ndarray):
    """All spans of each text, in bytes of the slice: by start, then kind."""
    data, offsets, base, tokens = _scan(texts)
    return data, offsets, [
        sorted(own + [(s, 3, e) for s, e, group, p in more if p >= least[group]]) for own, more in zip(base, tokens)
    ]


def secret_scan(documents: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document."""
    least = thresholds(token_counts(documents))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, found = _found(piece.column("text"), least)
        rows = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for i, spans in enumerate(found):
            told, kinds = [], [0] * len(KINDS)
            if spans:
                lo = int(offsets[i])
                points = np.cumsum((data[lo : offsets[i + 1]] & 0xC0) != 0x80)
                at = lambda b: int(points[b - lo - 1]) if b > lo else 0
                for s, kind, e in spans:
                    kinds[kind] += 1
                    told.append((kind, f"{KINDS[kind]}:{at(s)}:{at(e)}"))
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                rows[name].append(kinds[k])
            rows["base_sha256"].append(hashlib.sha256(",".join(t for k, t in told if k < 3).encode()).hexdigest())
            rows["spans"].append(",".join(t for _, t in told))
        return pa.RecordBatch.from_pydict(
            {"doc_id": piece.column("doc_id")} | {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in rows.items()}
        )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), "text", work, schema)


def redact(documents: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mask`` and ``n_chars`` set anew where the text changed.

    Documents without spans are returned as they are; a null text stays null.
    """
    least = thresholds(token_counts(documents))
    put = mask.encode()

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, found = _found(piece.column("text"), least)
        if not any(found):
            return piece
        texts = piece.column("text").to_pylist()
        sizes = piece.column("n_chars").to_pylist() if "n_chars" in piece.schema.names else None
        for i, spans in enumerate(found):
            if not spans:
                continue
            out, at = [], int(offsets[i])
            for s, _, e in spans:
                if s >= at:
                    out += [data[at:s].tobytes(), put]
                at = max(at, e)
            texts[i] = b"".join([*out, data[at : offsets[i + 1]].tobytes()]).decode()
            if sizes is not None:
                sizes[i] = len(texts[i])
        columns = {name: piece.column(name) for name in piece.schema.names}
        columns["text"] = pa.array(texts, piece.schema.field("text").type)
        if sizes is not None:
            columns["n_chars"] = pa.array(sizes, piece.schema.field("n_chars").type)
        return pa.RecordBatch.from_pydict(columns)

    return map_slices(documents, "text", work, documents.schema)
