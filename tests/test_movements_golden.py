"""The documented movement scenario on the sample rows, by every route."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from binledger import schemas
from binledger.sources.tables import load_tables
from binledger.operators import integrity, movements

COLUMNS = [c.split()[0] for c in schemas.MOVEMENT_DDL.split(", ")]


def command(seq, cmd, qty, **given):
    row = {"seq": seq, "cmd": cmd, "qty": Decimal(str(qty)), "employee_id": 1, **given}
    return tuple(row.get(c) for c in COLUMNS)


def line(seq, cmd, line_id, location, qty):
    return command(seq, cmd, qty, line_id=line_id, location_id=location)


def adjust(seq, slot, qty):
    p, w, loc = slot
    return command(seq, "ADJUST", qty, product_id=p, warehouse_id=w, location_id=loc)


def transfer(seq, product, source, target, qty):
    return command(
        seq, "TRANSFER", qty, product_id=product, warehouse_id=source[0], location_id=source[1],
        to_warehouse_id=target[0], to_location_id=target[1],
    )


SCENARIO = [
    line(1, "RECEIVE", 1, 1, 60),
    line(2, "RECEIVE", 1, 1, 50),
    line(3, "SHIP", 1, 1, 20),
    line(4, "SHIP", 2, 2, 100),
    adjust(5, (1, 2, 5), -21),
    adjust(6, (1, 2, 5), -26),
    adjust(7, (4, 1, 1), 0),
    transfer(8, 1, (1, 1), (2, 5), 30),
    adjust(9, (3, 1, 1), -1),
    adjust(10, (3, 1, 1), 10),
    line(11, "RECEIVE", 1, 1, 40),
    line(12, "RECEIVE", 2, 3, 500),
    line(13, "SHIP", 1, 1, 1),
    transfer(14, 1, (1, 1), (1, 1), 5),
    transfer(15, 4, (1, 1), (1, 2), 31),
    transfer(16, 4, (1, 1), (1, 2), 30),
]

REJECTED = {
    2: "EXCEEDS_OUTSTANDING", 5: "BELOW_RESERVED", 6: "INSUFFICIENT_STOCK", 7: "ZERO_QTY",
    9: "NO_INVENTORY_ROW", 13: "EXCEEDS_OUTSTANDING", 14: "SAME_BIN", 15: "INSUFFICIENT_STOCK",
}

FINAL_SLOTS = {
    (1, 1, 1): (170, 0), (2, 1, 2): (700, 0), (4, 1, 1): (0, 0), (1, 2, 5): (55, 5),
    (3, 1, 1): (10, 0), (3, 1, 3): (500, 0), (4, 1, 2): (30, 0),
}


@pytest.fixture(scope="module")
def commands(spark):
    return spark.createDataFrame(SCENARIO, schemas.movement_schema()).coalesce(1).cache()


@pytest.fixture(scope="module")
def result(commands, seeded):
    return movements.replay(commands, seeded, F.lit("2025-05-01 00:00:00").cast("timestamp"))


@pytest.mark.parametrize("chunk_rows", [1, 3])
def test_stretches_change_nothing(commands, seeded, result, chunk_rows):
    columns = ("seq", "code", "src_before", "dst_before")
    other = movements.outcomes(commands, seeded, chunk_rows=chunk_rows).select(*columns).collect()
    assert sorted(other) == sorted(result.outcomes.select(*columns).collect())


def test_rejects(result):
    assert {r.seq: r.reason for r in result.rejects().collect()} == REJECTED


def test_slots(result):
    rows = result.inventory().collect()
    slots = {
        (r.product_id, r.warehouse_id, r.location_id): (r.qty_on_hand, r.qty_reserved) for r in rows
    }
    assert slots == FINAL_SLOTS
    new = {(r.product_id, r.warehouse_id, r.location_id): r.inventory_id for r in rows}
    assert [new[s] for s in [(3, 1, 1), (3, 1, 3), (4, 1, 2)]] == [5, 6, 7]


def test_ledger(result, seeded):
    rows = result.ledger().orderBy("transaction_id").collect()
    got = [
        (r.transaction_id, r.seq, r.transaction_type, int(r.qty_before), int(r.qty_after),
         r.reference_type, r.reference_id)
        for r in rows
    ]
    assert got == [
        (3, 1, "RECEIPT", 120, 180, "GOODS_RECEIPT", 1),
        (4, 3, "ISSUE", 180, 160, "SHIPMENT", 1),
        (5, 4, "ISSUE", 800, 700, "SHIPMENT", 2),
        (6, 8, "TRANSFER_OUT", 160, 130, "TRANSFER", 2),
        (7, 8, "TRANSFER_IN", 25, 55, "TRANSFER", 2),
        (8, 10, "ADJUSTMENT", 0, 10, "MANUAL_ADJUSTMENT", None),
        (9, 11, "RECEIPT", 130, 170, "GOODS_RECEIPT", 2),
        (10, 12, "RECEIPT", 0, 500, "GOODS_RECEIPT", 3),
        (11, 16, "TRANSFER_OUT", 30, 0, "TRANSFER", 3),
        (12, 16, "TRANSFER_IN", 0, 30, "TRANSFER", 3),
    ]
    assert rows[0].notes == "Receipt for PO PO-2025-0001"
    assert rows[3].notes == "Transfer XFR-2025-0002 OUT to WH-2"
    assert rows[4].notes == "Transfer XFR-2025-0002 IN from WH-1"
    assert integrity.ledger_chain_check(result.ledger()).isEmpty()


def test_documents(result):
    receipts = result.goods_receipt().orderBy("receipt_id").collect()
    assert [r.receipt_number for r in receipts] == [f"GR-{n:010d}" for n in (1, 2, 3)]
    shipments = result.shipment().orderBy("shipment_id").collect()
    assert [(s.shipment_number, s.tracking_number, s.carrier) for s in shipments] == [
        ("SH-0000000001", "TRK-000001-US", "FedEx"),
        ("SH-0000000002", "TRK-000002-US", "FedEx"),
    ]
    transfers = result.stock_transfer().orderBy("transfer_id").collect()
    assert [(x.transfer_number, x.status, x.notes) for x in transfers] == [
        ("XFR-2025-0002", "COMPLETED", "Direct transfer"),
        ("XFR-2025-0003", "COMPLETED", "Direct transfer"),
    ]
    assert result.stock_transfer_line().count() == 2
    assert sorted(r.receipt_line_id for r in result.goods_receipt_line().collect()) == [1, 2, 3]
    assert sorted(r.shipment_line_id for r in result.shipment_line().collect()) == [1, 2]


def test_orders(result):
    assert [r.status for r in result.purchase_order().collect()] == ["RECEIVED"]
    assert [r.status for r in result.sales_order().collect()] == ["SHIPPED"]
    assert {r.po_line_id: int(r.qty_received) for r in result.po_line().collect()} == {
        1: 100, 2: 500,
    }


def test_written_snapshot(spark, result, tmp_path):
    movements.write_replay(result, str(tmp_path))
    loaded = load_tables(spark, str(tmp_path))
    before = {n: result.tables[n].count() for n in ("goods_receipt", "stock_transfer_line", "stock_transaction", "product")}
    added = {"goods_receipt": 3, "stock_transfer_line": 2, "stock_transaction": 10, "product": 0}
    assert {n: loaded[n].count() - before[n] for n in added} == added
    counts = {"inventory": 7, "po_line": 2, "sales_order": 1}
    assert {n: loaded[n].count() for n in counts} == counts
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 8
    again = movements.replay(spark.createDataFrame([], schemas.movement_schema()), loaded)
    assert sorted(again.inventory().collect()) == sorted(loaded["inventory"].collect())
