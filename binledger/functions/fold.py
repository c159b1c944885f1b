"""Applying the stock movements of one product, or of one stretch of them, one after another.

Quantities are whole thousandths. Opening rows bring the balances a stretch begins with; what
they don't name starts at nothing. A stretch that is one of several of its product also reports, for every slot and
line, the balance it began with, the balance it ended with and whether it turned a movement down.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# --- fixed values: reject reasons; the position is the code, 0 is "accepted" -----
REASONS = (
    "ACCEPTED",
    "MALFORMED",
    "NONPOSITIVE_QTY",
    "LINE_NOT_FOUND",
    "EXCEEDS_OUTSTANDING",
    "SAME_BIN",
    "SAME_LOCATION_ID",
    "UNKNOWN_REFERENCE",
    "ZERO_QTY",
    "NO_INVENTORY_ROW",
    "INSUFFICIENT_STOCK",
    "BELOW_RESERVED",
)
CODE = {reason: code for code, reason in enumerate(REASONS)}

#: OPEN brings a slot's balances; OPEN_LINE what its stretch's predecessors moved on a line (its kind in ``dst_wh``).
OPEN, RECEIVE, SHIP, ADJUST, TRANSFER, OPEN_LINE = range(6)
KINDS = ("OPEN", "RECEIVE", "SHIP", "ADJUST", "TRANSFER", "OPEN_LINE")

# Integer columns a row brings, in the order ``ProductState.apply`` takes them.
FIELDS = (
    "kind", "milli", "early", "middle", "late", "may_create",
    "line", "line_ordered", "line_done",
    "src_wh", "src_loc", "dst_wh", "dst_loc",
    "src_on_hand", "src_shipped", "src_reserved", "src_exists",
)

#: What a stretch reports of a slot (``kind`` 0, warehouse, bin) or a line (its kind, its id, 0).
CLOSING = pa.struct([
    ("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
    ("opened", pa.int64()), ("opened_shipped", pa.int64()), ("opened_exists", pa.int64()),
    ("closed", pa.int64()), ("closed_shipped", pa.int64()), ("closed_exists", pa.int64()),
    ("turned", pa.bool_()),
])
CLOSING_DDL = (
    "kind: bigint, a: bigint, b: bigint, opened: bigint, opened_shipped: bigint, opened_exists: bigint, "
    "closed: bigint, closed_shipped: bigint, closed_exists: bigint, turned: boolean"
)

_EXCEEDS = CODE["EXCEEDS_OUTSTANDING"]
_UNKNOWN = CODE["UNKNOWN_REFERENCE"]
_NO_ROW = CODE["NO_INVENTORY_ROW"]
_SHORT = CODE["INSUFFICIENT_STOCK"]
_RESERVED = CODE["BELOW_RESERVED"]


class ProductState:
    """Balances of one product's slots and order lines, as accepted movements change them."""

    __slots__ = ("slots", "lines", "began", "turned")

    def __init__(self) -> None:
        self.slots: dict = {}  # (warehouse, bin) -> [on hand, shipped, reserved at start, exists]
        self.lines: dict = {}  # (kind, line) -> quantity received or shipped
        self.began: dict = {}  # the same balances as opening rows brought them, by (kind, a, b)
        self.turned: set = set()  # slots and lines that turned a movement down

    def apply(
        self, kind, q, early, middle, late, may_create, line, ordered, done,
        src_wh, src_loc, dst_wh, dst_loc, on_hand, shipped, reserved, exists,
    ) -> tuple[int, int, int]:
        """Decide one movement: (code, source balance before, target balance before)."""
        if kind == OPEN:
            self.slots[(src_wh, src_loc)] = [on_hand, shipped, reserved, exists]
            self.began[(0, src_wh, src_loc)] = (on_hand, shipped, exists)
            return 0, 0, 0
        if kind == OPEN_LINE:
            self.lines[(dst_wh, line)] = q
            self.began[(dst_wh, line, 0)] = (q, 0, 1)
            return 0, 0, 0
        slot = self.slots.get((src_wh, src_loc))
        if slot is not None:
            on_hand, shipped, reserved, exists = slot
        if early:
            return early, on_hand, 0
        line_key = None
        if kind == RECEIVE or kind == SHIP:
            line_key = (kind, line)
            if done + self.lines.get(line_key, 0) + q > ordered:
                self.turned.add((kind, line, 0))
                return _EXCEEDS, on_hand, 0
            if middle:
                return middle, on_hand, 0
        change = q if kind == RECEIVE or kind == ADJUST else -q
        released = q if kind == SHIP else 0
        if not exists:
            if change < 0:
                self.turned.add((0, src_wh, src_loc))
                return _NO_ROW, on_hand, 0
            if not may_create:
                return _UNKNOWN, on_hand, 0
        after = on_hand + change
        if after < 0:
            self.turned.add((0, src_wh, src_loc))
            return _SHORT, on_hand, 0
        if max(0, reserved - shipped - released) > after:
            self.turned.add((0, src_wh, src_loc))
            return _RESERVED, on_hand, 0
        if late:
            return late, on_hand, 0
        if line_key is not None:
            self.lines[line_key] = self.lines.get(line_key, 0) + q
        if slot is None:
            self.slots[(src_wh, src_loc)] = [change, released, 0, 1]
        else:
            slot[0] = after
            slot[1] += released
            slot[3] = 1
        if kind != TRANSFER:
            return 0, on_hand, 0
        target = self.slots.setdefault((dst_wh, dst_loc), [0, 0, 0, 0])
        before = target[0]
        target[0] += q
        target[3] = 1
        return 0, on_hand, before

    def closings(self) -> Iterator[dict]:
        ended = {(0, *k): (v[0], v[1], v[3]) for k, v in self.slots.items()}
        ended |= {(*k, 0): (v, 0, 1) for k, v in self.lines.items()}
        for key, (closed, shipped, exists) in ended.items():
            began = self.began.get(key, (0, 0, 0))
            yield dict(
                zip(CLOSING.names, (*key, *began, closed, shipped, exists, key in self.turned), strict=True)
            )


def fold_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide rows that arrive sorted by product, stretch (``chunk``), openings first, and sequence.

    Only the state of the current stretch is held, never its rows. All input columns of commands pass through as they are,
    followed by the decision; opening rows end here. Stretches with a ``chunk`` of 0 or more end in rows that hold nothing but product, chunk and closing.
    """
    current, state, schema = None, ProductState(), None

    def report() -> Iterator[pa.RecordBatch]:
        if current is None or current[1] < 0:
            return
        made = list(state.closings())
        given = {"product_id": current[0], "chunk": current[1]}
        columns = [
            pa.array([given[f.name]] * len(made), f.type) if f.name in given else pa.nulls(len(made), f.type) for f in schema
        ]
        yield _result(columns, schema.names, [pa.nulls(len(made), pa.int64())] * 3, pa.array(made, CLOSING))

    for batch in batches:
        schema = batch.schema
        ints = [
            batch.column(name).to_numpy(zero_copy_only=False).tolist()
            for name in ("product_id", "chunk", *FIELDS)
        ]
        decisions = []
        for product, chunk, *row in zip(*ints, strict=True):
            if (product, chunk) != current:
                yield from report()
                current, state = (product, chunk), ProductState()
            decisions.append(state.apply(*row))
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        told = (kinds != OPEN) & (kinds != OPEN_LINE)
        results = np.array(decisions, dtype=np.int64).reshape(-1, 3)[told]
        decided = [pa.array(results[:, i]) for i in range(3)]
        columns = batch.filter(pa.array(told)).columns
        yield _result(columns, schema.names, decided, pa.nulls(len(results), CLOSING))
    yield from report()


def _result(columns, names, decided, closing) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*columns, *decided, closing], names=[*names, "code", "src_before", "dst_before", "closing"]
    )
