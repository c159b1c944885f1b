"""Listings and figures behind the read endpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger import schemas
from binledger.functions.scan import running_sums, whole_quotient
from binledger.operators import views
from binledger.sources.tables import Tables

QTY, VALUE = views.QTY, views.VALUE

#: Lines on one row of a nested order.
PAGE_LINES = 10_000


def dashboard_metrics(t: Tables, as_of: str | Column | None = None) -> DataFrame:
    """One row of headline figures; sums over nothing are 0."""
    count = F.count(F.lit(1))
    return figures(
        t,
        views.stock_valuation(t),
        views.low_stock(t).agg(count.alias("low_stock_count")),
        views.pending_shipments(t).agg(count.alias("pending_shipments")),
        views.overdue_purchase_orders(t, as_of).agg(count.alias("overdue_pos")),
    )


def figures(t: Tables, valuation: DataFrame, *others: DataFrame) -> DataFrame:
    """Totals of a valuation, rows of one figure each, and what the dimensions count.

    Each figure is its own one-row aggregate; the rows are stacked and added up,
    so no figure waits for another and none is joined.
    """
    count = F.count(F.lit(1))
    parts = [
        valuation.agg(
            F.sum("total_cost_value").cast(VALUE).alias("total_cost_value"),
            F.sum("total_retail_value").cast(VALUE).alias("total_retail_value"),
            F.sum("total_units").cast(QTY).alias("total_units"),
        ),
        *others,
        views.active(t["warehouse"]).agg(count.alias("warehouse_count")),
        views.active(t["product"]).agg(count.alias("product_count")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(
        *[
            F.coalesce(F.sum(f.name), F.lit(0)).cast(f.dataType).alias(f.name)
            for f in stacked.schema.fields
        ]
    )


def full_name() -> Column:
    """First and last name; NULL when there is no employee."""
    return F.concat("first_name", F.lit(" "), "last_name")


def _employee_names(t: Tables, key: str, name: str) -> DataFrame:
    return t["employee"].select(F.col("employee_id").alias(key), full_name().alias(name))


def _latest(t: Tables, n: int) -> DataFrame:
    """The newest ``n`` log rows whose product and warehouse exist; names are joined to these alone."""
    log = t["stock_transaction"]
    for table, key in (("product", "product_id"), ("warehouse", "warehouse_id")):
        log = log.join(t[table].select(key), key, "left_semi")
    return log.select(*_log_columns()).orderBy(F.desc("transaction_id")).limit(n)


def _log_columns() -> list[str]:
    return schemas.table_schema("stock_transaction").fieldNames()


def _with_names(t: Tables, log: DataFrame, with_employee: bool) -> DataFrame:
    warehouse = ["warehouse_id", "warehouse_code"] + (["warehouse_name"] if with_employee else [])
    named = (
        log.join(t["product"].select("product_id", "sku", "product_name"), "product_id")
        .join(t["warehouse"].select(*warehouse), "warehouse_id")
        .join(t["warehouse_location"].select("location_id", "location_code"), "location_id", "left")
    )
    extra = ["sku", "product_name", *warehouse[1:], "location_code"]
    if with_employee:
        named = named.join(_employee_names(t, "employee_id", "employee_name"), "employee_id", "left")
        extra.append("employee_name")
    return named.select(*_log_columns(), *extra).orderBy(F.desc("transaction_id"))


def recent_transactions(t: Tables, n: int = 10) -> DataFrame:
    return _with_names(t, _latest(t, n), with_employee=False)


def transactions(t: Tables, n: int = 100) -> DataFrame:
    return _with_names(t, _latest(t, n), with_employee=True)


def latest_audit(t: Tables, n: int = 20) -> DataFrame:
    return t["stock_transaction"].orderBy(F.desc("transaction_id")).limit(n)


def audit_by_date(t: Tables) -> DataFrame:
    return (
        t["stock_transaction"]
        .orderBy(F.desc("transaction_date"))
        .select(
            "transaction_id", "transaction_type", "qty_change", "qty_before", "qty_after",
            "reference_type", "notes",
        )
    )


def inventory_listing(t: Tables, ordered: bool = True) -> DataFrame:
    """Every inventory slot with names, inactive ones included."""
    rows = views.stock_rows(t, only_active=False).select(
        "inventory_id", "product_id", "warehouse_id", "location_id", "warehouse_code",
        "warehouse_name", "zone_type", "location_code", "sku", "product_name", "category_name",
        "qty_on_hand", "qty_reserved", "qty_available", "reorder_level", "unit_cost", "unit_price",
        "stock_value", "updated_at",
    )
    return rows.orderBy("warehouse_code", "sku") if ordered else rows


def products(t: Tables) -> DataFrame:
    categories = t["product_category"].select("category_id", "category_code", "category_name")
    columns = schemas.table_schema("product").fieldNames()
    return (
        t["product"]
        .join(categories, "category_id")
        .select(*columns, "category_code", "category_name")
        .orderBy("sku")
    )


def active_warehouses(t: Tables) -> DataFrame:
    return views.active(t["warehouse"])


def active_locations(t: Tables) -> DataFrame:
    """Active bins with the code of their warehouse, active or not."""
    columns = schemas.table_schema("warehouse_location").fieldNames()
    return (
        views.active(t["warehouse_location"])
        .join(t["warehouse"].select("warehouse_id", "warehouse_code"), "warehouse_id")
        .select(*columns, "warehouse_code")
    )


def active_employees(t: Tables) -> DataFrame:
    return views.active(t["employee"]).select(
        "employee_id", "employee_code", "first_name", "last_name", "job_title"
    )


def nest_lines(
    headers: DataFrame, lines: DataFrame, key: str, order: str, page_rows: int = PAGE_LINES
) -> DataFrame:
    """Headers with their lines as arrays sorted by ``order``, a page a row.

    Page p holds the lines at positions ``p * page_rows + 1`` to ``(p + 1) * page_rows`` of
    their header; every header has a page 0, which is [] without lines. One rule for all sizes.
    """
    rest = [c for c in lines.columns if c != order]
    placed = running_sums(lines, [key], [order, *rest], {"__place": F.lit(1).cast("bigint")}, F.col(order).cast("bigint"))
    page = whole_quotient(F.col("__place") - 1, page_rows).cast("int").alias("page")
    listed = F.sort_array(F.collect_list(F.struct(order, *rest))).alias("lines")
    nested = placed.groupBy(key, page).agg(listed)
    return headers.join(nested, key, "left").withColumns(
        {"page": F.coalesce("page", F.lit(0)), "lines": F.coalesce("lines", F.array())}
    )


def _line_items(t: Tables, table: str) -> DataFrame:
    items = t["product"].select("product_id", "sku", "product_name", "unit_of_measure")
    columns = schemas.table_schema(table).fieldNames()
    return t[table].join(items, "product_id").select(
        *columns, "sku", "product_name", "unit_of_measure"
    )


def _named_orders(t: Tables, table: str, partner: str) -> DataFrame:
    partners = t[partner].select(f"{partner}_id", f"{partner}_name", f"{partner}_code")
    warehouses = t["warehouse"].select("warehouse_id", "warehouse_code", "warehouse_name")
    columns = schemas.table_schema(table).fieldNames()
    return (
        t[table]
        .join(partners, f"{partner}_id")
        .join(warehouses, "warehouse_id")
        .join(_employee_names(t, "created_by", "created_by_name"), "created_by", "left")
        .select(
            *columns, f"{partner}_name", f"{partner}_code", "warehouse_code", "warehouse_name",
            "created_by_name",
        )
    )


def purchase_orders_nested(t: Tables, ordered: bool = True) -> DataFrame:
    orders = nest_lines(
        _named_orders(t, "purchase_order", "supplier"), _line_items(t, "po_line"),
        "po_id", "line_number",
    )
    return orders.orderBy(F.desc("po_id"), "page") if ordered else orders


def sales_orders_nested(t: Tables, ordered: bool = True) -> DataFrame:
    orders = nest_lines(
        _named_orders(t, "sales_order", "customer"), _line_items(t, "so_line"),
        "so_id", "line_number",
    )
    return orders.orderBy(F.desc("so_id"), "page") if ordered else orders


def transfers_nested(t: Tables, ordered: bool = True) -> DataFrame:
    """Transfers with both warehouse codes; the lines keep unmatched products and bins."""

    def role(table: str, key: str, code: str, side: str, key_as: str) -> DataFrame:
        return t[table].select(F.col(key).alias(key_as), F.col(code).alias(f"{side}_{code}"))

    headers = (
        t["stock_transfer"]
        .join(role("warehouse", "warehouse_id", "warehouse_code", "from", "from_warehouse_id"),
              "from_warehouse_id")
        .join(role("warehouse", "warehouse_id", "warehouse_code", "to", "to_warehouse_id"),
              "to_warehouse_id")
        .select(
            *schemas.table_schema("stock_transfer").fieldNames(),
            "from_warehouse_code", "to_warehouse_code",
        )
    )
    lines = (
        t["stock_transfer_line"]
        .join(t["product"].select("product_id", "sku", "product_name"), "product_id", "left")
        .join(role("warehouse_location", "location_id", "location_code", "from",
                   "from_location_id"), "from_location_id", "left")
        .join(role("warehouse_location", "location_id", "location_code", "to",
                   "to_location_id"), "to_location_id", "left")
        .select(
            *schemas.table_schema("stock_transfer_line").fieldNames(),
            "sku", "product_name", "from_location_code", "to_location_code",
        )
    )
    nested = nest_lines(headers, lines, "transfer_id", "transfer_line_id")
    return nested.orderBy(F.desc("transfer_id"), "page") if ordered else nested
