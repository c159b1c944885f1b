"""The views and figures on the sample rows, worked out by hand."""

from decimal import Decimal

from pyspark.sql import functions as F

from binledger import schemas
from binledger.operators import integrity, keys, picking, reports, views
from binledger.sources import seed
from binledger.sources import tables as loading


def test_inventory_by_warehouse(seeded):
    rows = views.inventory_by_warehouse(seeded).collect()
    assert sorted((int(r.qty_available), float(r.stock_value)) for r in rows) == [
        (20, 1125.0), (30, 360.0), (110, 5400.0), (750, 2000.0),
    ]


def test_low_stock(seeded):
    rows = views.low_stock(seeded).collect()
    assert sorted((r.warehouse_code, r.sku, int(r.qty_shortage)) for r in rows) == [
        ("WH-EAST", "SKU-3001", 70), ("WH-WEST", "SKU-1001", 25),
    ]


def test_orders(seeded):
    (row,) = views.open_purchase_orders(seeded).collect()
    assert (row.po_number, row.line_count, int(row.qty_outstanding)) == ("PO-2025-0001", 2, 600)
    (late,) = views.overdue_purchase_orders(seeded, "2025-04-20").collect()
    assert (late.days_overdue, int(late.qty_still_outstanding)) == (5, 600)
    assert views.overdue_purchase_orders(seeded, "2025-04-15").isEmpty()
    assert views.pending_shipments(seeded).isEmpty()


def test_dashboard(seeded):
    (row,) = reports.dashboard_metrics(seeded, "2025-04-20").collect()
    assert [float(v) for v in row] == [8885.0, 20175.55, 975.0, 2, 0, 1, 2, 4]


def test_totals_and_bins(spark, seeded):
    assert [r.total_amount for r in keys.header_totals(seeded, "purchase_order").collect()] == [
        Decimal("4600.00")
    ]
    assert [r.total_amount for r in keys.header_totals(seeded, "sales_order").collect()] == [
        Decimal("2598.80")
    ]
    requests = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 2), (3, 3, 1)], "request_id long, product_id long, warehouse_id long"
    )
    best = picking.best_source_bin(seeded, requests).collect()
    assert {r.request_id: (r.best_location_id, int(r.available)) for r in best} == {
        1: (1, 110), 2: (5, 20), 3: (None, 0),
    }


def test_filled_quantity(spark):
    frame = spark.createDataFrame(
        [(10, None), (10, 4), (10, 12), (10, -1), (0, 5)], "free int, typed int"
    )
    got = frame.select(picking.filled_quantity(F.col("free"), F.col("typed")).alias("q")).collect()
    assert [r.q for r in got] == [1, 4, 10, 1, 5]


def test_long_headers_are_paged(seeded):
    headers = seeded["sales_order"].select("so_id")
    lines = seeded["so_line"].select("so_id", "line_number", "product_id")
    nested = reports.nest_lines(headers, lines, "so_id", "line_number", page_rows=1).collect()
    assert sorted(line.line_number for r in nested for line in r.lines) == [1, 2]
    assert len(nested) == 2


def test_snapshot_round_trip(spark, tmp_path):
    loading.reseed(spark, str(tmp_path))
    tables = loading.load_tables(spark, str(tmp_path))
    assert {n: df.count() for n, df in tables.items()} == {
        n: len(seed.SEED_ROWS.get(n, ((), []))[1]) for n in schemas.TABLE_DDL
    }
    assert integrity.check_violations(tables).isEmpty()
    loading.register_views(spark, tables, "2025-04-20")
    assert spark.sql("SELECT days_overdue FROM v_overdue_purchase_orders").first()[0] == 5
