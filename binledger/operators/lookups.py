"""Keyed look-ups: equality on a few columns, newest or oldest first where dated.

Each is a pushed-down filter. Tables laid out by these columns also skip files: the log lies in folders by
type and month, and where it is read with its ``transaction_month`` (``Snapshots.log_months``) a date
range also asks for its months, so that other folders aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.sources.tables import Tables


@dataclass(frozen=True)
class Lookup:
    table: str
    keys: tuple[str, ...]
    date: str | None = None


# --- fixed values: the access paths the data model is indexed for ------------
LOOKUPS: dict[str, Lookup] = {
    "employees_by_department": Lookup("employee", ("department_id",)),
    "products_by_category": Lookup("product", ("category_id",)),
    "products_by_name": Lookup("product", ("product_name",)),
    "bins_by_warehouse": Lookup("warehouse_location", ("warehouse_id",)),
    "stock_by_product": Lookup("inventory", ("product_id",)),
    "stock_by_warehouse": Lookup("inventory", ("warehouse_id",)),
    "stock_by_bin": Lookup("inventory", ("location_id",)),
    "stock_by_product_warehouse": Lookup("inventory", ("product_id", "warehouse_id")),
    "purchase_orders_by_supplier_status": Lookup("purchase_order", ("supplier_id", "status")),
    "purchase_orders_by_warehouse": Lookup("purchase_order", ("warehouse_id",), "order_date"),
    "po_lines_by_product": Lookup("po_line", ("product_id",)),
    "receipts_by_order": Lookup("goods_receipt", ("po_id",), "receipt_date"),
    "receipt_lines_by_receipt": Lookup("goods_receipt_line", ("receipt_id",)),
    "receipt_lines_by_po_line": Lookup("goods_receipt_line", ("po_line_id",)),
    "sales_orders_by_customer_status": Lookup("sales_order", ("customer_id", "status")),
    "sales_orders_by_warehouse": Lookup("sales_order", ("warehouse_id",), "order_date"),
    "so_lines_by_product": Lookup("so_line", ("product_id",)),
    "shipments_by_order_status": Lookup("shipment", ("so_id", "status")),
    "shipment_lines_by_shipment": Lookup("shipment_line", ("shipment_id",)),
    "shipment_lines_by_so_line": Lookup("shipment_line", ("so_line_id",)),
    "transfers_by_source_status": Lookup("stock_transfer", ("from_warehouse_id", "status")),
    "transfers_by_target_status": Lookup("stock_transfer", ("to_warehouse_id", "status")),
    "transfer_lines_by_transfer": Lookup("stock_transfer_line", ("transfer_id",)),
    "transfer_lines_by_product": Lookup("stock_transfer_line", ("product_id",)),
    "movements_by_product": Lookup("stock_transaction", ("product_id",), "transaction_date"),
    "movements_by_warehouse": Lookup("stock_transaction", ("warehouse_id",), "transaction_date"),
    "movements_by_warehouse_type": Lookup(
        "stock_transaction", ("warehouse_id", "transaction_type"), "transaction_date"
    ),
    "movements_by_reference": Lookup("stock_transaction", ("reference_type", "reference_id")),
}


def lookup(
    t: Tables, name: str, *values, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows of look-up ``name`` whose keys equal ``values``, dated in [start, end)."""
    path = LOOKUPS[name]
    rows = t[path.table]
    for key, value in zip(path.keys, values, strict=True):
        rows = rows.where(F.col(key) == value)
    if path.date is None:
        return rows.drop("transaction_month")
    for bound, test in ((start, F.col(path.date) >= F.lit(start)), (end, F.col(path.date) < F.lit(end))):
        if bound is None:
            continue
        rows = rows.where(test)
        if "transaction_month" in rows.columns:
            month = F.date_format(F.lit(bound).cast("timestamp"), "yyyy-MM")
            rows = rows.where(F.col("transaction_month") >= month if bound is start else F.col("transaction_month") <= month)
    return rows.drop("transaction_month").orderBy(path.date)
