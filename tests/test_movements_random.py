"""Random batches against a plain sequential model, with one product taking half of them."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from binledger import schemas
from binledger.operators import integrity, movements

COLUMNS = [c.split()[0] for c in schemas.MOVEMENT_DDL.split(", ")]
LINES = {  # (kind, line) -> product, warehouse, ordered
    ("RECEIVE", 1): (1, 1, 100), ("RECEIVE", 2): (3, 1, 500),
    ("SHIP", 1): (1, 1, 20), ("SHIP", 2): (2, 1, 100),
}
START = {(1, 1, 1): [120, 10], (2, 1, 2): [800, 50], (4, 1, 1): [30, 0], (1, 2, 5): [25, 5]}


def batch(seed, size):
    pick = random.Random(seed)
    rows = []
    for seq in range(1, size + 1):
        cmd = pick.choice(["RECEIVE", "SHIP", "ADJUST", "ADJUST", "ADJUST", "TRANSFER", "TRANSFER"])
        row = {"seq": seq * 3, "cmd": cmd, "employee_id": pick.choice([1, 2, 3, None, 9, 1, 2, 3])}
        row["location_id"] = pick.choice([1, 2, 3, 4, 5, 1, 1, 77, None, 1, 2, 5])
        quantity = pick.choice([1, 2, 3, 5, 8, 13, 40, 0, "0.125", "2.5"])
        if cmd in ("RECEIVE", "SHIP"):
            row["line_id"] = pick.choice([1, 1, 2, 2, 8, None])
            row["header_id"] = pick.choice([None, None, None, 55])
        else:
            row["product_id"] = pick.choice([1, 1, 1, 1, 2, 3, 4, 6])
            row["warehouse_id"] = pick.choice([1, 1, 1, 2, 7])
            if cmd == "TRANSFER":
                row["to_warehouse_id"] = pick.choice([1, 2, 2])
                row["to_location_id"] = pick.choice([1, 2, 5, 6])
        row["qty"] = Decimal(str(quantity)) * (-1 if pick.random() < 0.45 else 1)
        if pick.random() < 0.03:
            row["qty"] = None
        rows.append(row)
    return rows


def model(rows):
    """One movement after the other on dictionaries."""
    slots = {k: list(v) for k, v in START.items()}
    done = dict.fromkeys(LINES, Decimal(0))
    bins, employees, products, warehouses = set(range(1, 7)), {1, 2, 3}, {1, 2, 3, 4}, {1, 2}
    verdicts = {}

    def change(slot, qty, who, release=Decimal(0)):
        hand, held = slots.get(slot, (None, Decimal(0)))
        if hand is None:
            if qty < 0:
                return "NO_INVENTORY_ROW"
            if slot[0] not in products or slot[1] not in warehouses or slot[2] not in bins:
                return "UNKNOWN_REFERENCE"
            hand = Decimal(0)
        held = max(Decimal(0), held - release)
        if hand + qty < 0:
            return "INSUFFICIENT_STOCK"
        if held > hand + qty:
            return "BELOW_RESERVED"
        if who not in employees:
            return "UNKNOWN_REFERENCE"
        slots[slot] = [hand + qty, held]
        return None

    def decide(r):
        cmd, qty, loc = r["cmd"], r["qty"], r["location_id"]
        who = 1 if r["employee_id"] is None else r["employee_id"]
        if qty is None or loc is None:
            return "MALFORMED"
        if cmd in ("RECEIVE", "SHIP"):
            if r["line_id"] is None:
                return "MALFORMED"
            if qty <= 0:
                return "NONPOSITIVE_QTY"
            line = (cmd, r["line_id"])
            if line not in LINES:
                return "LINE_NOT_FOUND"
            product, warehouse, ordered = LINES[line]
            if done[line] + qty > ordered:
                return "EXCEEDS_OUTSTANDING"
            if who not in employees or loc not in bins or r["header_id"] is not None:
                return "UNKNOWN_REFERENCE"
            slot = (product, warehouse, loc)
            fault = change(slot, qty, who) if cmd == "RECEIVE" else change(slot, -qty, who, qty)
            if fault is None:
                done[line] += qty
            return fault
        slot = (r["product_id"], r["warehouse_id"], loc)
        if cmd == "ADJUST":
            return "ZERO_QTY" if qty == 0 else change(slot, qty, who)
        target = (r["product_id"], r["to_warehouse_id"], r["to_location_id"])
        if slot == target:
            return "SAME_BIN"
        if qty <= 0:
            return "NONPOSITIVE_QTY"
        if who not in employees or slot[1] not in warehouses:
            return "UNKNOWN_REFERENCE"
        if loc == r["to_location_id"]:
            return "SAME_LOCATION_ID"
        if slot[0] not in products or loc not in bins:
            return "UNKNOWN_REFERENCE"
        fault = change(slot, -qty, who)
        if fault is None:
            assert change(target, qty, who) is None
        return fault

    for r in rows:
        verdicts[r["seq"]] = decide(r) or "ACCEPTED"
    return verdicts, {k: (v[0], v[1]) for k, v in slots.items()}


@pytest.fixture(scope="module")
def case(spark):
    rows = batch(7, 500)
    frame = spark.createDataFrame(
        [tuple(r.get(c) for c in COLUMNS) for r in rows], schemas.movement_schema()
    )
    return frame.coalesce(1).cache(), *model(rows)


def names(outcomes):
    return {
        r.seq: r.name
        for r in outcomes.select("seq", movements.reason_name().alias("name")).collect()
    }


def test_folded(spark, case, seeded):
    commands, verdicts, slots = case
    assert len(set(verdicts.values())) >= 11
    result = movements.replay(commands, seeded, F.current_timestamp())
    assert names(result.outcomes) == verdicts
    got = {
        (r.product_id, r.warehouse_id, r.location_id): (r.qty_on_hand, r.qty_reserved)
        for r in result.inventory().collect()
    }
    assert got == slots
    ledger = result.ledger().cache()
    assert integrity.ledger_chain_check(ledger).isEmpty()
    moved = {
        (r.product_id, r.warehouse_id, r.location_id): r.total
        for r in ledger.groupBy("product_id", "warehouse_id", "location_id")
        .agg(F.sum("qty_change").alias("total")).collect()
    }
    for slot, (hand, _) in slots.items():
        assert moved.get(slot, 0) == hand - START.get(slot, [0])[0]


@pytest.mark.parametrize("chunk_rows", [8, 64])
def test_stretches(case, seeded, chunk_rows):
    commands, verdicts, _ = case
    decided = movements.outcomes(commands, seeded, chunk_rows=chunk_rows).cache()
    assert names(decided) == verdicts
    whole = movements.outcomes(commands, seeded)
    columns = ("seq", "code", "src_before", "dst_before")
    assert sorted(decided.select(*columns).collect()) == sorted(whole.select(*columns).collect())


@pytest.mark.parametrize("seed", [21, 22])
def test_stretches_of_a_product_near_zero(spark, seeded, seed):
    rows = [{**r, "product_id": 1} if "product_id" in r else r for r in batch(seed, 400)]
    commands = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], schemas.movement_schema())
    assert names(movements.outcomes(commands, seeded, chunk_rows=5)) == model(rows)[0]


def test_repeated_and_missing_positions_are_rejected(spark, seeded):
    row = {"cmd": "ADJUST", "product_id": 1, "warehouse_id": 1, "location_id": 1, "qty": Decimal(1), "employee_id": 1}
    rows = [tuple({**row, "seq": s}.get(c) for c in COLUMNS) for s in (5, 5, None, 7)]
    free = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.movement_schema().fields)
    result = movements.replay(spark.createDataFrame(rows, free), seeded, F.current_timestamp())
    codes = sorted((r.seq or 0, r.name) for r in result.outcomes.select("seq", movements.reason_name().alias("name")).collect())
    assert codes == [(0, "MALFORMED"), (5, "MALFORMED"), (5, "MALFORMED"), (7, "ACCEPTED")]
    assert result.ledger().count() == 1
    hand = {(r.product_id, r.warehouse_id, r.location_id): r.qty_on_hand for r in result.inventory().collect()}
    assert hand[(1, 1, 1)] == START.get((1, 1, 1), [0])[0] + 1


def test_used_transfer_numbers_are_skipped(spark, seeded):
    stored = seeded["stock_transfer"]
    clash = stored.withColumns(
        {"transfer_id": F.lit(0).cast("bigint"), "transfer_number": F.lit("XFR-2025-0003")}
    )
    tables = {**seeded, "stock_transfer": stored.unionAll(clash)}
    row = {
        "cmd": "TRANSFER", "product_id": 1, "warehouse_id": 1, "location_id": 1,
        "to_warehouse_id": 2, "to_location_id": 5, "qty": Decimal(1), "employee_id": 1,
    }
    rows = [tuple({**row, "seq": s}.get(c) for c in COLUMNS) for s in (1, 2, 3)]
    commands = spark.createDataFrame(rows, schemas.movement_schema())
    made = movements.replay(commands, tables).stock_transfer().orderBy("transfer_id").collect()
    assert [(r.transfer_id, r.transfer_number) for r in made] == [
        (2, "XFR-2025-0002"), (3, "XFR-2025-0004"), (4, "XFR-2025-0005"),
    ]
