"""The sample rows a fresh installation starts with."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from binledger import schemas

SEED_TIME = "2025-04-20 00:00:00"

# --- fixed values: sample rows; columns not listed are NULL or take the default --
SEED_ROWS: dict[str, tuple[tuple[str, ...], list[tuple]]] = {
    "uom_lookup": (
        ("uom_code", "uom_description"),
        [
            ("EA", "Each"), ("KG", "Kilogram"), ("LTR", "Litre"), ("BOX", "Box"),
            ("PLT", "Pallet"), ("MTR", "Metre"), ("PKT", "Packet"),
        ],
    ),
    "department": (
        ("department_id", "department_code", "department_name"),
        [(1, "OPS", "Warehouse Operations"), (2, "PROC", "Procurement")],
    ),
    "employee": (
        ("employee_id", "department_id", "employee_code", "first_name", "last_name", "email",
         "job_title", "hire_date"),
        [
            (1, 1, "E001", "Maria", "Chen", "maria.chen@wms.local", "Warehouse Manager",
             "2020-03-15"),
            (2, 2, "E002", "James", "Wilson", "james.wilson@wms.local", "Procurement Specialist",
             "2021-06-01"),
            (3, 1, "E003", "Aisha", "Patel", "aisha.patel@wms.local", "Inventory Clerk",
             "2022-01-10"),
        ],
    ),
    "product_category": (
        ("category_id", "category_code", "category_name", "description"),
        [
            (1, "ELEC", "Electronics", "Electronic components and devices"),
            (2, "PACK", "Packaging", "Boxes, labels, and packing materials"),
            (3, "RAW", "Raw Materials", "Base materials for manufacturing"),
        ],
    ),
    "product": (
        ("product_id", "category_id", "sku", "product_name", "unit_cost", "unit_price",
         "reorder_level"),
        [
            (1, 1, "SKU-1001", "Wireless Router Pro AX3000", "45.00", "89.99", "50"),
            (2, 1, "SKU-1002", "Ethernet Cable Cat6 10ft", "2.50", "7.99", "200"),
            (3, 2, "SKU-2001", "Corrugated Box Medium 18x12x10", "0.85", "2.49", "500"),
            (4, 3, "SKU-3001", "Steel Bracket Assembly Heavy Duty", "12.00", "24.50", "100"),
        ],
    ),
    "supplier": (
        ("supplier_id", "supplier_code", "supplier_name", "contact_name", "email", "city"),
        [
            (1, "SUP-01", "Global Tech Supplies Inc.", "Robert Kim",
             "orders@globaltech.example", "Dallas"),
            (2, "SUP-02", "PackRight Materials LLC", "Lisa Nguyen",
             "sales@packright.example", "Chicago"),
        ],
    ),
    "customer": (
        ("customer_id", "customer_code", "customer_name", "contact_name", "email", "city"),
        [
            (1, "CUST-01", "RetailMart Distribution", "Tom Bradley",
             "purchasing@retailmart.example", "Atlanta"),
            (2, "CUST-02", "NetPro Solutions", "Sandra Lee", "orders@netpro.example", "Seattle"),
        ],
    ),
    "warehouse": (
        ("warehouse_id", "warehouse_code", "warehouse_name", "city", "state_province",
         "manager_id", "capacity_units"),
        [
            (1, "WH-EAST", "East Coast Distribution Center", "Newark", "NJ", 1, "50000"),
            (2, "WH-WEST", "West Coast Fulfillment Hub", "Los Angeles", "CA", 1, "40000"),
        ],
    ),
    "warehouse_location": (
        ("location_id", "warehouse_id", "location_code", "aisle", "rack", "bin", "zone_type"),
        [
            (1, 1, "A-01-01", "A", "01", "01", "STORAGE"),
            (2, 1, "A-01-02", "A", "01", "02", "STORAGE"),
            (3, 1, "RCV-01", "RCV", "01", "01", "RECEIVING"),
            (4, 1, "SHP-01", "SHP", "01", "01", "SHIPPING"),
            (5, 2, "B-01-01", "B", "01", "01", "STORAGE"),
            (6, 2, "RCV-02", "RCV", "02", "01", "RECEIVING"),
        ],
    ),
    "inventory": (
        ("inventory_id", "product_id", "warehouse_id", "location_id", "qty_on_hand",
         "qty_reserved"),
        [
            (1, 1, 1, 1, "120", "10"), (2, 2, 1, 2, "800", "50"),
            (3, 4, 1, 1, "30", "0"), (4, 1, 2, 5, "25", "5"),
        ],
    ),
    "purchase_order": (
        ("po_id", "po_number", "supplier_id", "warehouse_id", "order_date", "expected_date",
         "status", "total_amount", "created_by"),
        [(1, "PO-2025-0001", 1, 1, "2025-04-01", "2025-04-15", "APPROVED", "4600.00", 2)],
    ),
    "po_line": (
        ("po_line_id", "po_id", "line_number", "product_id", "qty_ordered", "unit_cost"),
        [(1, 1, 1, 1, "100", "42.00"), (2, 1, 2, 3, "500", "0.80")],
    ),
    "sales_order": (
        ("so_id", "so_number", "customer_id", "warehouse_id", "order_date", "required_date",
         "status", "total_amount", "created_by"),
        [(1, "SO-2025-0100", 2, 1, "2025-04-20", "2025-04-25", "CONFIRMED", "2598.80", 3)],
    ),
    "so_line": (
        ("so_line_id", "so_id", "line_number", "product_id", "qty_ordered", "unit_price"),
        [(1, 1, 1, 1, "20", "89.99"), (2, 1, 2, 2, "100", "7.99")],
    ),
    "stock_transfer": (
        ("transfer_id", "transfer_number", "from_warehouse_id", "to_warehouse_id",
         "request_date", "status", "requested_by"),
        [(1, "XFR-2025-0001", 1, 2, "2025-04-18", "REQUESTED", 1)],
    ),
    "stock_transfer_line": (
        ("transfer_line_id", "transfer_id", "product_id", "from_location_id", "to_location_id",
         "qty_requested"),
        [(1, 1, 1, 1, 5, "30")],
    ),
    "stock_transaction": (
        ("transaction_id", "product_id", "warehouse_id", "location_id", "transaction_type",
         "qty_change", "qty_before", "qty_after", "reference_type", "employee_id", "notes"),
        [
            (1, 1, 1, 1, "RECEIPT", "120", "0", "120", "INITIAL_LOAD", 3, "Opening balance load"),
            (2, 2, 1, 2, "RECEIPT", "800", "0", "800", "INITIAL_LOAD", 3, "Opening balance load"),
        ],
    ),
}


def _value(raw, kind: T.DataType):
    if raw is None or isinstance(kind, (T.StringType, T.LongType, T.IntegerType)):
        return raw
    if isinstance(kind, T.DecimalType):
        return Decimal(raw)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(raw[:10])
    return datetime.fromisoformat(raw)


def _rows(name: str) -> list[tuple]:
    schema = schemas.table_schema(name)
    columns, rows = SEED_ROWS.get(name, ((), []))
    stamped = {"now": SEED_TIME, "today": SEED_TIME}
    defaults = {c: stamped.get(d, d) for c, d in schemas.DEFAULTS.get(name, {}).items()}
    full = []
    for row in rows:
        given = {**defaults, **dict(zip(columns, row, strict=True))}
        if name in ("po_line", "so_line"):
            unit = given.get("unit_cost") or given.get("unit_price")
            given["line_total"] = Decimal(given["qty_ordered"]) * Decimal(unit)
        full.append(tuple(_value(given.get(f.name), f.dataType) for f in schema.fields))
    return full


def seed_table(spark: SparkSession, name: str) -> DataFrame:
    schema = schemas.table_schema(name)
    # A local relation has a known size, so joins with it are broadcast.
    columns = [list(c) for c in zip(*_rows(name), strict=True)] or [[] for _ in schema.fields]
    kinds = to_arrow_schema(schema)
    return spark.createDataFrame(
        pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds),
        schema,
    )


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """All 21 tables holding the sample rows (a few dozen, a fixed number)."""
    return {name: seed_table(spark, name) for name in schemas.TABLE_DDL}
