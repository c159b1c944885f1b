"""The six reporting views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger.sources.tables import Tables

OPEN_STATUSES = ("SUBMITTED", "APPROVED", "PARTIAL")
EN_ROUTE_STATUSES = ("PENDING", "IN_TRANSIT")

QTY = "decimal(18,3)"
VALUE = "decimal(24,5)"


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_active") == "Y")


def stock_rows(t: Tables, only_active: bool) -> DataFrame:
    """Inventory slots with their product, category, warehouse and bin."""
    pick = active if only_active else (lambda df: df)
    products = pick(t["product"]).select(
        "product_id", "category_id", "sku", "product_name", "reorder_level", "unit_cost",
        "unit_price",
    )
    categories = t["product_category"].select("category_id", "category_name")
    warehouses = pick(t["warehouse"]).select("warehouse_id", "warehouse_code", "warehouse_name")
    bins = pick(t["warehouse_location"]).select("location_id", "location_code", "zone_type")
    return (
        t["inventory"]
        .join(warehouses, "warehouse_id")
        .join(bins, "location_id")
        .join(products.join(categories, "category_id"), "product_id")
        .withColumns(
            {
                "qty_available": (F.col("qty_on_hand") - F.col("qty_reserved")).cast(QTY),
                "stock_value": (F.col("qty_on_hand") * F.col("unit_cost")).cast(VALUE),
            }
        )
    )


def inventory_by_warehouse(t: Tables) -> DataFrame:
    return stock_rows(t, only_active=True).select(
        "warehouse_code", "warehouse_name", "zone_type", "location_code", "sku", "product_name",
        "category_name", "qty_on_hand", "qty_reserved", "qty_available", "reorder_level",
        "unit_cost", "stock_value", "last_count_date", "updated_at",
    )


def _stock_per_product(t: Tables) -> DataFrame:
    """On-hand totals per warehouse and product, added up before any join.

    SKU and warehouse code are unique, so grouping by ids equals grouping by names.
    """
    return t["inventory"].groupBy("warehouse_id", "product_id").agg(
        F.sum("qty_on_hand").cast(QTY).alias("total_on_hand")
    )


def low_stock(t: Tables, per_product: DataFrame | None = None) -> DataFrame:
    """Products short of stock in a warehouse; ``per_product`` takes totals kept elsewhere."""
    warehouses = active(t["warehouse"]).select("warehouse_id", "warehouse_code", "warehouse_name")
    products = active(t["product"]).select(
        "product_id", "sku", "product_name", "reorder_level"
    )
    held = _stock_per_product(t) if per_product is None else per_product
    return (
        held.join(warehouses, "warehouse_id")
        .join(products, "product_id")
        .where(F.col("total_on_hand") < F.col("reorder_level"))
        .select(
            "warehouse_code", "warehouse_name", "sku", "product_name", "total_on_hand",
            "reorder_level",
            (F.col("reorder_level") - F.col("total_on_hand")).cast(QTY).alias("qty_shortage"),
        )
    )


def _outstanding(t: Tables) -> DataFrame:
    """Line count and open quantity per purchase order, before any join."""
    return t["po_line"].groupBy("po_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.col("qty_ordered") - F.col("qty_received")).cast(QTY).alias("qty_outstanding"),
    )


def _open_orders(t: Tables) -> DataFrame:
    return t["purchase_order"].where(F.col("status").isin(*OPEN_STATUSES))


def open_purchase_orders(t: Tables, outstanding: DataFrame | None = None) -> DataFrame:
    """Orders still to be received. An order without lines does not appear."""
    return (
        _open_orders(t)
        .join(_outstanding(t) if outstanding is None else outstanding, "po_id")
        .join(t["supplier"].select("supplier_id", "supplier_name"), "supplier_id")
        .join(t["warehouse"].select("warehouse_id", "warehouse_code"), "warehouse_id")
        .select(
            "po_number", "supplier_name", "warehouse_code", "order_date", "expected_date",
            "updated_at", "status", "total_amount", "line_count", "qty_outstanding",
        )
    )


def stock_valuation(t: Tables) -> DataFrame:
    """Units and value per warehouse and category.

    A product has one row per warehouse after the first aggregation, so counting
    rows counts distinct products.
    """
    warehouses = active(t["warehouse"]).select("warehouse_id", "warehouse_code", "warehouse_name")
    products = active(t["product"]).select("product_id", "category_id", "unit_cost", "unit_price")
    categories = t["product_category"].select("category_id", "category_name")
    units = F.col("total_on_hand")
    return (
        _stock_per_product(t)
        .join(warehouses, "warehouse_id")
        .join(products.join(categories, "category_id"), "product_id")
        .groupBy("warehouse_code", "warehouse_name", "category_name")
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            F.sum(units).cast(QTY).alias("total_units"),
            F.sum(units * F.col("unit_cost")).cast(VALUE).alias("total_cost_value"),
            F.sum(units * F.col("unit_price")).cast(VALUE).alias("total_retail_value"),
        )
    )


def pending_shipments(t: Tables) -> DataFrame:
    """Shipments on their way. A shipment without lines does not appear."""
    shipped = t["shipment_line"].groupBy("shipment_id").agg(
        F.sum("qty_shipped").cast(QTY).alias("total_qty_shipped")
    )
    orders = t["sales_order"].select(
        "so_id", "so_number", "customer_id", "warehouse_id", "required_date"
    )
    return (
        t["shipment"]
        .where(F.col("status").isin(*EN_ROUTE_STATUSES))
        .join(shipped, "shipment_id")
        .join(orders, "so_id")
        .join(t["customer"].select("customer_id", "customer_name"), "customer_id")
        .join(t["warehouse"].select("warehouse_id", "warehouse_code"), "warehouse_id")
        .select(
            "so_number", "customer_name", "warehouse_code", "required_date", "shipment_number",
            "ship_date", "status", "carrier", "tracking_number", "reason_code",
            "total_qty_shipped",
        )
    )


def day_of(as_of: str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of


def overdue_purchase_orders(
    t: Tables, as_of: str | Column | None = None, ordered: bool = False
) -> DataFrame:
    """Open orders whose expected day lies before ``as_of`` (default: today)."""
    day = day_of(as_of)
    late = (
        _open_orders(t)
        .where(F.col("expected_date") < day)
        .join(_outstanding(t), "po_id")
        .join(
            t["supplier"].select(
                "supplier_id", "supplier_name", F.col("email").alias("supplier_email")
            ),
            "supplier_id",
        )
        .join(t["warehouse"].select("warehouse_id", "warehouse_code"), "warehouse_id")
        .select(
            "po_number", "supplier_name", "supplier_email", "warehouse_code", "order_date",
            "expected_date", F.datediff(day, "expected_date").alias("days_overdue"), "status",
            "total_amount", F.col("qty_outstanding").alias("qty_still_outstanding"),
        )
    )
    return late.orderBy(F.desc("days_overdue")) if ordered else late


# view name -> builder; the overdue view takes a day and is registered apart
VIEWS = {
    "v_inventory_by_warehouse": inventory_by_warehouse,
    "v_low_stock": low_stock,
    "v_open_purchase_orders": open_purchase_orders,
    "v_stock_valuation": stock_valuation,
    "v_pending_shipments": pending_shipments,
}
