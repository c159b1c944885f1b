"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, documents, and attention cost (sum of squared piece
lengths). A piece goes, longest first, into a sequence where it fits under all three and
leaves the smallest weighted residual norm (or has the largest weighted dot product with what is left).

All three needs of a piece follow from its length, so pieces of one length are interchangeable
and so are sequences with equal contents. The search therefore runs over *kinds* of
sequences with multiplicities: its input is the count of pieces of each length (at most
``capacity`` numbers, whatever the size of the corpus), its output a table of slots. Pieces
are then ranked within their length by a distributed running total and rank r takes slot r. Every
piece is placed as a best-fit over the whole corpus would place it; nothing is packed shard by shard.

Defined results: a null text is empty and gives one piece with the end id alone; repeated rows and null
doc_ids are packed as rows of their own; an empty table gives no rows. By default documents and attention are
bounded only by what the tokens allow, so that the tokens alone decide the number of sequences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.llm.ranges import hex_key, running_totals
from binledger.llm.tokens import encoder
from binledger.llm.words import map_slices
from binledger.session import cut

CAPACITY = 2048
END_ID = 0
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of tokens, documents and attention in the choice."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    choose: str = "norm"  # or "dot"

    @property
    def caps(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)

    @property
    def longest(self) -> int:
        """The longest piece that fits into an empty sequence."""
        return min(self.tokens, int(np.sqrt(float(self.caps[2])) + 1e-9))


@dataclass
class Slots:
    """Where pieces of one length go: the r-th goes to the part where ``upto`` first exceeds r."""

    upto: np.ndarray
    sequence: np.ndarray  # first sequence of the part
    each: np.ndarray  # pieces of this length in each of its sequences
    offset: np.ndarray  # of the first of them


def plan(counts: dict[int, int], limits: Limits) -> tuple[dict[int, Slots], int]:
    """Slots for every length, and the number of sequences."""
    caps, weights = limits.caps, np.array(limits.weights)
    left = np.zeros((64, 3), np.int64)
    number = np.zeros(64, np.int64)
    contents: list[tuple] = []  # of each kind: (length, how many, offset of the first)

    def add(n: int, rest: np.ndarray, content: tuple) -> None:
        nonlocal left, number
        k = len(contents)
        if k == len(number):
            left, number = np.concatenate([left, np.zeros_like(left)]), np.concatenate([number, np.zeros_like(number)])
        left[k], number[k] = rest, n
        contents.append(content)

    for length in sorted(counts, reverse=True):
        todo, need = counts[length], np.array([length, 1, length * length], np.int64)
        while todo:
            n = len(contents)
            fits = np.flatnonzero((left[:n] >= need).all(axis=1) & (number[:n] > 0))
            if len(fits):
                rest, want = left[fits] / caps, need / caps
                score = (weights * rest * want).sum(axis=1) if limits.choose == "dot" else -(weights * (rest - want) ** 2).sum(axis=1)
                kind = int(fits[np.argmax(score)])
                room, have, content = left[kind].copy(), int(number[kind]), contents[kind]
            else:
                kind, room, have, content = -1, caps, todo, ()
            most = int((room // need).min())
            each = min(most, todo)
            many = min(have, todo // each)
            begin = limits.tokens - int(room[0])
            made = (room - each * need, (*content, (length, each, begin)))
            if kind >= 0 and many == have:
                left[kind], contents[kind] = made
            else:
                if kind >= 0:
                    number[kind] -= many
                add(many, *made)
            todo -= many * each
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    total = 0
    for content, n in zip(contents, number.tolist()):
        if n:
            for length, each, begin in content:
                parts.setdefault(length, []).append((n * each, total, each, begin))
            total += n
    slots = {}
    for length, rows in parts.items():
        size, sequence, each, offset = map(np.array, zip(*rows))
        slots[length] = Slots(np.cumsum(size), sequence, each, offset)
    return slots, total


def pieces(documents: DataFrame, longest: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ids of the whole text, then the end id, cut only if longer than ``longest``.

    ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``. The first piece takes the remainder.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encoder(path).encode(piece.column("text"))
        row, number, start, length, crc, body = [], [], [], [], [], []
        for i in range(piece.num_rows):
            own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(END_ID)).astype("<u4")
            n = -(-len(own) // longest)
            at = 0
            for p in range(n):
                size = len(own) - longest * (n - 1) if p == 0 else longest
                raw = own[at : at + size].tobytes()
                row.append(i)
                number.append(p)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(raw))
                if with_ids:
                    body.append(np.frombuffer(raw, "<i4"))
                at += size
        columns = {
            "doc_id": piece.column("doc_id").take(pa.array(row)),
            "piece": pa.array(number, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(body, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), "text", work, schema, SLICE_BYTES)


def pack(documents: DataFrame, limits: Limits = Limits(), path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces with the sequence each is in and its offset there."""
    made = cut(pieces(documents, limits.longest, path, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # a row per length
    slots, _ = plan(counts, limits)
    keyed = made.withColumn("_key", hex_key("doc_id", "piece", salt="pack")).withColumn("_one", F.lit(1))
    ranked = running_totals(keyed, "length", "_key", "_one", ["doc_id", "piece", "start", "ids_crc32"], "_rank").drop("_key", "_one")

    columns_of = made.columns

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                at, s = np.flatnonzero(lengths == length), slots[length]
                part = np.searchsorted(s.upto, ranks[at], side="right")
                inside = ranks[at] - np.where(part > 0, s.upto[part - 1], 0)
                sequence[at] = s.sequence[part] + inside // s.each[part]
                offset[at] = s.offset[part] + inside % s.each[part] * length
            columns = {name: batch.column(name) for name in columns_of}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    schema = made.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    return ranked.select(*made.columns, "_rank").mapInArrow(place, schema)
