"""Table schemas and integrity rules, held as data.

Everything below the "fixed values" marks has to equal the public data model
(names, types, domains), because user queries refer to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: table columns ------------------------------------------
TABLE_DDL: dict[str, str] = {
    "uom_lookup": "uom_code STRING NOT NULL, uom_description STRING NOT NULL",
    "department": (
        "department_id BIGINT NOT NULL, department_code STRING NOT NULL, "
        "department_name STRING NOT NULL, created_at TIMESTAMP NOT NULL"
    ),
    "employee": (
        "employee_id BIGINT NOT NULL, department_id BIGINT NOT NULL, "
        "employee_code STRING NOT NULL, first_name STRING NOT NULL, "
        "last_name STRING NOT NULL, email STRING, phone STRING, job_title STRING, "
        "hire_date DATE NOT NULL, is_active STRING NOT NULL, created_at TIMESTAMP NOT NULL"
    ),
    "product_category": (
        "category_id BIGINT NOT NULL, category_code STRING NOT NULL, "
        "category_name STRING NOT NULL, description STRING"
    ),
    "product": (
        "product_id BIGINT NOT NULL, category_id BIGINT NOT NULL, sku STRING NOT NULL, "
        "product_name STRING NOT NULL, description STRING, unit_of_measure STRING NOT NULL, "
        "unit_cost DECIMAL(12,2) NOT NULL, unit_price DECIMAL(12,2) NOT NULL, "
        "reorder_level DECIMAL(10,3) NOT NULL, is_active STRING NOT NULL, "
        "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
    ),
    "supplier": (
        "supplier_id BIGINT NOT NULL, supplier_code STRING NOT NULL, "
        "supplier_name STRING NOT NULL, contact_name STRING, email STRING, phone STRING, "
        "address_line1 STRING, city STRING, state_province STRING, postal_code STRING, "
        "country STRING, is_active STRING NOT NULL, created_at TIMESTAMP NOT NULL, "
        "updated_at TIMESTAMP NOT NULL"
    ),
    "customer": (
        "customer_id BIGINT NOT NULL, customer_code STRING NOT NULL, "
        "customer_name STRING NOT NULL, contact_name STRING, email STRING, phone STRING, "
        "address_line1 STRING, city STRING, state_province STRING, postal_code STRING, "
        "country STRING, is_active STRING NOT NULL, created_at TIMESTAMP NOT NULL, "
        "updated_at TIMESTAMP NOT NULL"
    ),
    "warehouse": (
        "warehouse_id BIGINT NOT NULL, warehouse_code STRING NOT NULL, "
        "warehouse_name STRING NOT NULL, address_line1 STRING, city STRING, "
        "state_province STRING, postal_code STRING, country STRING, manager_id BIGINT, "
        "capacity_units DECIMAL(12,2), is_active STRING NOT NULL, created_at TIMESTAMP NOT NULL"
    ),
    "warehouse_location": (
        "location_id BIGINT NOT NULL, warehouse_id BIGINT NOT NULL, "
        "location_code STRING NOT NULL, aisle STRING, rack STRING, bin STRING, "
        "zone_type STRING NOT NULL, max_capacity DECIMAL(12,2), is_active STRING NOT NULL"
    ),
    "inventory": (
        "inventory_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
        "warehouse_id BIGINT NOT NULL, location_id BIGINT NOT NULL, "
        "qty_on_hand DECIMAL(12,3) NOT NULL, qty_reserved DECIMAL(12,3) NOT NULL, "
        "last_count_date DATE, updated_at TIMESTAMP NOT NULL"
    ),
    "purchase_order": (
        "po_id BIGINT NOT NULL, po_number STRING NOT NULL, supplier_id BIGINT NOT NULL, "
        "warehouse_id BIGINT NOT NULL, order_date DATE NOT NULL, expected_date DATE, "
        "status STRING NOT NULL, total_amount DECIMAL(14,2) NOT NULL, created_by BIGINT, "
        "notes STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
    ),
    "po_line": (
        "po_line_id BIGINT NOT NULL, po_id BIGINT NOT NULL, line_number INT NOT NULL, "
        "product_id BIGINT NOT NULL, qty_ordered DECIMAL(12,3) NOT NULL, "
        "qty_received DECIMAL(12,3) NOT NULL, unit_cost DECIMAL(12,2) NOT NULL, "
        "line_total DECIMAL(14,2)"
    ),
    "goods_receipt": (
        "receipt_id BIGINT NOT NULL, receipt_number STRING NOT NULL, po_id BIGINT NOT NULL, "
        "receipt_date DATE NOT NULL, received_by BIGINT, reason_code STRING NOT NULL, "
        "notes STRING, created_at TIMESTAMP NOT NULL"
    ),
    "goods_receipt_line": (
        "receipt_line_id BIGINT NOT NULL, receipt_id BIGINT NOT NULL, "
        "po_line_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
        "location_id BIGINT NOT NULL, qty_received DECIMAL(12,3) NOT NULL"
    ),
    "sales_order": (
        "so_id BIGINT NOT NULL, so_number STRING NOT NULL, customer_id BIGINT NOT NULL, "
        "warehouse_id BIGINT NOT NULL, order_date DATE NOT NULL, required_date DATE, "
        "status STRING NOT NULL, total_amount DECIMAL(14,2) NOT NULL, created_by BIGINT, "
        "notes STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
    ),
    "so_line": (
        "so_line_id BIGINT NOT NULL, so_id BIGINT NOT NULL, line_number INT NOT NULL, "
        "product_id BIGINT NOT NULL, qty_ordered DECIMAL(12,3) NOT NULL, "
        "qty_shipped DECIMAL(12,3) NOT NULL, unit_price DECIMAL(12,2) NOT NULL, "
        "line_total DECIMAL(14,2)"
    ),
    "shipment": (
        "shipment_id BIGINT NOT NULL, shipment_number STRING NOT NULL, so_id BIGINT NOT NULL, "
        "ship_date DATE NOT NULL, carrier STRING, tracking_number STRING, "
        "status STRING NOT NULL, shipped_by BIGINT, reason_code STRING NOT NULL, "
        "created_at TIMESTAMP NOT NULL"
    ),
    "shipment_line": (
        "shipment_line_id BIGINT NOT NULL, shipment_id BIGINT NOT NULL, "
        "so_line_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
        "location_id BIGINT NOT NULL, qty_shipped DECIMAL(12,3) NOT NULL"
    ),
    "stock_transfer": (
        "transfer_id BIGINT NOT NULL, transfer_number STRING NOT NULL, "
        "from_warehouse_id BIGINT NOT NULL, to_warehouse_id BIGINT NOT NULL, "
        "request_date DATE NOT NULL, ship_date DATE, receive_date DATE, "
        "status STRING NOT NULL, requested_by BIGINT, notes STRING, "
        "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
    ),
    "stock_transfer_line": (
        "transfer_line_id BIGINT NOT NULL, transfer_id BIGINT NOT NULL, "
        "product_id BIGINT NOT NULL, from_location_id BIGINT NOT NULL, "
        "to_location_id BIGINT NOT NULL, qty_requested DECIMAL(12,3) NOT NULL, "
        "qty_shipped DECIMAL(12,3) NOT NULL, qty_received DECIMAL(12,3) NOT NULL"
    ),
    "stock_transaction": (
        "transaction_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
        "warehouse_id BIGINT NOT NULL, location_id BIGINT, transaction_type STRING NOT NULL, "
        "qty_change DECIMAL(12,3) NOT NULL, qty_before DECIMAL(12,3), "
        "qty_after DECIMAL(12,3), reference_type STRING, reference_id BIGINT, "
        "employee_id BIGINT, transaction_date TIMESTAMP NOT NULL, notes STRING"
    ),
}

# Arguments of the four stock movements, one row per command, ordered by seq.
MOVEMENT_DDL = (
    "seq BIGINT NOT NULL, cmd STRING NOT NULL, line_id BIGINT, product_id BIGINT, "
    "warehouse_id BIGINT, location_id BIGINT, to_warehouse_id BIGINT, "
    "to_location_id BIGINT, qty DECIMAL(12,3), employee_id BIGINT, header_id BIGINT, "
    "reason_code STRING, carrier STRING, tracking_number STRING, notes STRING"
)

# --- fixed values: keys ------------------------------------------------------
PRIMARY_KEY: dict[str, str] = {
    "uom_lookup": "uom_code",
    "department": "department_id",
    "employee": "employee_id",
    "product_category": "category_id",
    "product": "product_id",
    "supplier": "supplier_id",
    "customer": "customer_id",
    "warehouse": "warehouse_id",
    "warehouse_location": "location_id",
    "inventory": "inventory_id",
    "purchase_order": "po_id",
    "po_line": "po_line_id",
    "goods_receipt": "receipt_id",
    "goods_receipt_line": "receipt_line_id",
    "sales_order": "so_id",
    "so_line": "so_line_id",
    "shipment": "shipment_id",
    "shipment_line": "shipment_line_id",
    "stock_transfer": "transfer_id",
    "stock_transfer_line": "transfer_line_id",
    "stock_transaction": "transaction_id",
}

UNIQUE_KEY: dict[str, tuple[str, ...]] = {
    "department": ("department_code",),
    "employee": ("employee_code",),
    "product_category": ("category_code",),
    "product": ("sku",),
    "supplier": ("supplier_code",),
    "customer": ("customer_code",),
    "warehouse": ("warehouse_code",),
    "warehouse_location": ("warehouse_id", "location_code"),
    "inventory": ("product_id", "warehouse_id", "location_id"),
    "purchase_order": ("po_number",),
    "po_line": ("po_id", "line_number"),
    "goods_receipt": ("receipt_number",),
    "sales_order": ("so_number",),
    "so_line": ("so_id", "line_number"),
    "shipment": ("shipment_number",),
    "stock_transfer": ("transfer_number",),
}

# child table -> (child column, parent table); the parent column is its key
FOREIGN_KEYS: dict[str, tuple[tuple[str, str], ...]] = {
    "employee": (("department_id", "department"),),
    "product": (("category_id", "product_category"), ("unit_of_measure", "uom_lookup")),
    "warehouse": (("manager_id", "employee"),),
    "warehouse_location": (("warehouse_id", "warehouse"),),
    "inventory": (
        ("product_id", "product"),
        ("warehouse_id", "warehouse"),
        ("location_id", "warehouse_location"),
    ),
    "purchase_order": (
        ("supplier_id", "supplier"),
        ("warehouse_id", "warehouse"),
        ("created_by", "employee"),
    ),
    "po_line": (("po_id", "purchase_order"), ("product_id", "product")),
    "goods_receipt": (("po_id", "purchase_order"), ("received_by", "employee")),
    "goods_receipt_line": (
        ("receipt_id", "goods_receipt"),
        ("po_line_id", "po_line"),
        ("product_id", "product"),
        ("location_id", "warehouse_location"),
    ),
    "sales_order": (
        ("customer_id", "customer"),
        ("warehouse_id", "warehouse"),
        ("created_by", "employee"),
    ),
    "so_line": (("so_id", "sales_order"), ("product_id", "product")),
    "shipment": (("so_id", "sales_order"), ("shipped_by", "employee")),
    "shipment_line": (
        ("shipment_id", "shipment"),
        ("so_line_id", "so_line"),
        ("product_id", "product"),
        ("location_id", "warehouse_location"),
    ),
    "stock_transfer": (
        ("from_warehouse_id", "warehouse"),
        ("to_warehouse_id", "warehouse"),
        ("requested_by", "employee"),
    ),
    "stock_transfer_line": (
        ("transfer_id", "stock_transfer"),
        ("product_id", "product"),
        ("from_location_id", "warehouse_location"),
        ("to_location_id", "warehouse_location"),
    ),
    "stock_transaction": (
        ("product_id", "product"),
        ("warehouse_id", "warehouse"),
        ("location_id", "warehouse_location"),
        ("employee_id", "employee"),
    ),
}

# header table -> (line table, header key); deleting a header deletes its lines
CASCADES: dict[str, tuple[str, str]] = {
    "purchase_order": ("po_line", "po_id"),
    "goods_receipt": ("goods_receipt_line", "receipt_id"),
    "sales_order": ("so_line", "so_id"),
    "shipment": ("shipment_line", "shipment_id"),
    "stock_transfer": ("stock_transfer_line", "transfer_id"),
}

# --- fixed values: column defaults; "today" and "now" stand for the load time --
DEFAULTS: dict[str, dict[str, str]] = {
    "department": {"created_at": "now"},
    "employee": {"is_active": "Y", "created_at": "now"},
    "product": {
        "unit_of_measure": "EA", "unit_cost": "0", "unit_price": "0", "reorder_level": "0",
        "is_active": "Y", "created_at": "now", "updated_at": "now",
    },
    "supplier": {"country": "USA", "is_active": "Y", "created_at": "now", "updated_at": "now"},
    "customer": {"country": "USA", "is_active": "Y", "created_at": "now", "updated_at": "now"},
    "warehouse": {"country": "USA", "is_active": "Y", "created_at": "now"},
    "warehouse_location": {"zone_type": "STORAGE", "is_active": "Y"},
    "inventory": {"qty_on_hand": "0", "qty_reserved": "0", "updated_at": "now"},
    "purchase_order": {
        "order_date": "today", "status": "DRAFT", "total_amount": "0",
        "created_at": "now", "updated_at": "now",
    },
    "po_line": {"qty_received": "0"},
    "goods_receipt": {"receipt_date": "today", "reason_code": "STANDARD", "created_at": "now"},
    "sales_order": {
        "order_date": "today", "status": "DRAFT", "total_amount": "0",
        "created_at": "now", "updated_at": "now",
    },
    "so_line": {"qty_shipped": "0"},
    "shipment": {
        "ship_date": "today", "status": "PENDING", "reason_code": "STANDARD", "created_at": "now",
    },
    "stock_transfer": {
        "request_date": "today", "status": "REQUESTED", "created_at": "now", "updated_at": "now",
    },
    "stock_transfer_line": {"qty_shipped": "0", "qty_received": "0"},
    "stock_transaction": {"transaction_date": "now"},
}

# Tables whose rows carry a modification time that every update refreshes.
TOUCHED_TABLES = (
    "product", "supplier", "customer", "inventory",
    "purchase_order", "sales_order", "stock_transfer",
)

# --- fixed values: status and code domains per rule profile --------------------
DOMAINS: dict[str, dict[str, tuple[str, ...]]] = {
    "database": {
        "flag": ("Y", "N"),
        "zone": ("STORAGE", "PICKING", "RECEIVING", "SHIPPING", "QUARANTINE"),
        "po_status": ("DRAFT", "SUBMITTED", "APPROVED", "PARTIAL", "RECEIVED", "CANCELLED"),
        "so_status": ("DRAFT", "CONFIRMED", "PICKING", "PARTIAL", "SHIPPED", "CANCELLED"),
        "shipment_status": ("PENDING", "IN_TRANSIT", "DELIVERED", "CANCELLED"),
        "transfer_status": ("REQUESTED", "IN_TRANSIT", "RECEIVED", "CANCELLED"),
        "receipt_reason": ("STANDARD", "INITIAL_LOAD", "RETURN_TO_STOCK", "DAMAGE_CLAIM"),
        "shipment_reason": ("STANDARD", "PARTIAL_SHIP", "URGENT", "RETURN"),
        "transaction_type": (
            "RECEIPT", "ISSUE", "ADJUSTMENT", "TRANSFER_IN", "TRANSFER_OUT", "RETURN",
        ),
    },
    "application": {
        "flag": ("Y", "N"),
        "zone": ("STORAGE", "RECEIVING", "SHIPPING", "STAGING", "QC", "CROSS_DOCK"),
        "po_status": ("DRAFT", "SUBMITTED", "APPROVED", "PARTIAL", "RECEIVED", "CANCELLED"),
        "so_status": ("DRAFT", "CONFIRMED", "ALLOCATED", "PARTIAL", "SHIPPED", "CANCELLED"),
        "shipment_status": ("PENDING", "IN_TRANSIT", "DELIVERED", "CANCELLED"),
        "transfer_status": ("REQUESTED", "IN_TRANSIT", "COMPLETED", "CANCELLED"),
    },
}


@cache
def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_DDL[name])


@cache
def movement_schema() -> T.StructType:
    return T.StructType.fromDDL(MOVEMENT_DDL)


def required_columns(name: str) -> list[str]:
    return [f.name for f in table_schema(name).fields if not f.nullable]


@dataclass(frozen=True)
class Check:
    """A row rule of one table: a row breaks it when ``holds`` is FALSE, not NULL."""

    rule_id: str
    table: str
    holds: Column


def check_rules(profile: str = "database") -> list[Check]:
    """The row rules of a profile."""
    domains = DOMAINS[profile]
    full = profile == "database"

    def among(column: str, domain: str) -> Column:
        return F.col(column).isin(*domains[domain])

    def at_least_zero(*columns: str) -> Column:
        test = F.col(columns[0]) >= 0
        for name in columns[1:]:
            test = test & (F.col(name) >= 0)
        return test

    def progress(done: str) -> Column:
        ordered = F.col("qty_ordered") > 0
        if full:
            return ordered & F.col(done).between(F.lit(0), F.col("qty_ordered"))
        return ordered & at_least_zero(done)

    rules = [
        Check("K-01", "employee", among("is_active", "flag")),
        Check("K-02", "product", among("is_active", "flag")),
        Check("K-04", "supplier", among("is_active", "flag")),
        Check("K-05", "customer", among("is_active", "flag")),
        Check("K-06", "warehouse", among("is_active", "flag")),
        Check("K-07", "warehouse_location", among("zone_type", "zone")),
        Check("K-08", "warehouse_location", among("is_active", "flag")),
        Check("K-10", "inventory", F.col("qty_reserved").between(F.lit(0), F.col("qty_on_hand"))),
        Check("K-11", "purchase_order", among("status", "po_status")),
        Check("K-13", "po_line", progress("qty_received")),
        Check("K-15", "goods_receipt_line", F.col("qty_received") > 0),
        Check("K-16", "sales_order", among("status", "so_status")),
        Check("K-18", "so_line", progress("qty_shipped")),
        Check("K-19", "shipment", among("status", "shipment_status")),
        Check("K-21", "shipment_line", F.col("qty_shipped") > 0),
        Check("K-23", "stock_transfer", among("status", "transfer_status")),
        Check(
            "K-24", "stock_transfer_line",
            F.col("from_location_id") != F.col("to_location_id"),
        ),
    ]
    if full:
        rules += [
            Check("K-03", "product", at_least_zero("unit_cost", "unit_price", "reorder_level")),
            Check("K-09", "inventory", at_least_zero("qty_on_hand")),
            Check("K-12", "po_line", F.col("line_number") > 0),
            Check("K-14", "goods_receipt", among("reason_code", "receipt_reason")),
            Check("K-17", "so_line", F.col("line_number") > 0),
            Check("K-20", "shipment", among("reason_code", "shipment_reason")),
            Check(
                "K-22", "stock_transfer",
                F.col("from_warehouse_id") != F.col("to_warehouse_id"),
            ),
            Check(
                "K-25", "stock_transfer_line",
                (F.col("qty_requested") > 0) & at_least_zero("qty_shipped", "qty_received"),
            ),
            Check("K-26", "stock_transaction", among("transaction_type", "transaction_type")),
        ]
    else:
        rules += [
            Check("K-25", "stock_transfer_line", F.col("qty_requested") > 0),
            Check("R-01", "po_line", at_least_zero("unit_cost")),
            Check("R-02", "so_line", at_least_zero("unit_price")),
        ]
    return sorted(rules, key=lambda r: r.rule_id)
