"""Reporting aggregates that a batch moves on instead of computing them anew.

Two levels of small tables are kept beside the stock tables:

* ``stock`` (slots and units per warehouse and product), ``orders`` (lines and open quantity per purchase order)
  and ``loads`` (lines and quantity per shipment) are sums over the large tables;
* ``value`` (products, units, values and products short of stock per warehouse and category), ``due`` (open orders per
  expected day) and ``en_route`` (shipments on their way per status) are sums over those.

A batch gives a delta for each. On the first level it is a sum of what the accepted commands moved. On the second, a group
of the first that moved counts twice: as it was with weight -1, as it is with weight 1. All columns are sums of
weighted rows, so old and new add up exactly in decimals, and a group whose count falls to 0 is gone. A product is one row of
``stock`` per warehouse, so counting rows counts distinct products and takes them back again. The large
tables are not added up again: a delta reads the batch, the slots and headers it touched, and the kept tables.

Defined results: sums skip NULL; a group with rows and only NULL quantities holds 0. Rows of the stock tables with a NULL
key are a group of their own, which no view shows. An empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger.operators import reports, views
from binledger.operators.deciding import kind_is
from binledger.operators.movements import Replay, quantity
from binledger.session import cut, shuffles_removed
from binledger.sources.snapshots import Snapshots, at_once
from binledger.sources.tables import Tables

QTY, VALUE = views.QTY, views.VALUE

#: kept table -> its keys; the first column after them counts rows, and the others are sums
KEYS = {
    "stock": ["warehouse_id", "product_id"],
    "orders": ["po_id"],
    "loads": ["shipment_id"],
    "value": ["warehouse_id", "category_id"],
    "due": ["expected_date"],
    "en_route": ["status"],
}
#: What decides how a product counts in ``value``.
PRODUCT_FACTS = ["category_id", "unit_cost", "unit_price", "reorder_level", "is_active"]


def _sum(value: Column | str, kind: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(kind)


def _weighed(rows: DataFrame, weight: int = 1) -> DataFrame:
    return rows.withColumn("weight", F.lit(weight).cast("bigint"))


def _moved(old: DataFrame, new: DataFrame) -> DataFrame:
    return _weighed(old, -1).unionByName(_weighed(new))


def merged(kept: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """A kept table with a delta added; groups without rows are gone."""
    sums = [f for f in kept.schema.fields if f.name not in keys]
    both = kept.unionByName(delta.select(*kept.columns)).groupBy(*keys)
    return both.agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in sums]).where(F.col(sums[0].name) > 0)


# -- the second level: sums over weighted rows of the first ------------------------


def _value(stock: DataFrame, t: Tables) -> DataFrame:
    """What weighted rows of ``stock`` add to ``value``."""
    products = views.active(t["product"]).select("product_id", *PRODUCT_FACTS)
    warehouses = views.active(t["warehouse"]).select("warehouse_id")
    units, weight = F.col("total_on_hand"), F.col("weight")
    return (
        stock.join(warehouses, "warehouse_id", "left_semi")
        .join(products, "product_id")
        .groupBy(*KEYS["value"])
        .agg(
            F.sum(weight).alias("product_count"),
            _sum(weight * units, QTY).alias("total_units"),
            _sum(weight * units * F.col("unit_cost"), VALUE).alias("total_cost_value"),
            _sum(weight * units * F.col("unit_price"), VALUE).alias("total_retail_value"),
            _sum(F.when(units < F.col("reorder_level"), weight), "bigint").alias("low_stock_count"),
        )
    )


def _due(headers: DataFrame, t: Tables) -> DataFrame:
    """What weighted purchase orders that have lines add to ``due``."""
    return (
        headers.where(F.col("status").isin(*views.OPEN_STATUSES))
        .join(t["supplier"].select("supplier_id"), "supplier_id", "left_semi")
        .join(t["warehouse"].select("warehouse_id"), "warehouse_id", "left_semi")
        .groupBy("expected_date")
        .agg(F.sum("weight").alias("n_orders"))
    )


def _en_route(shipments: DataFrame, t: Tables) -> DataFrame:
    """What weighted shipments that have lines add to ``en_route``."""
    orders = (
        t["sales_order"].select("so_id", "customer_id", "warehouse_id")
        .join(t["customer"].select("customer_id"), "customer_id", "left_semi")
        .join(t["warehouse"].select("warehouse_id"), "warehouse_id", "left_semi")
    )
    return (
        shipments.where(F.col("status").isin(*views.EN_ROUTE_STATUSES))
        .join(orders, "so_id", "left_semi")
        .groupBy("status")
        .agg(F.sum("weight").alias("n_shipments"))
    )


_HEADER = ["po_id", "supplier_id", "warehouse_id", "expected_date", "status"]


# -- from nothing, and from what was kept ------------------------------------------


def compute(t: Tables) -> dict[str, DataFrame]:
    """All kept tables from the stock tables themselves."""
    count = F.count(F.lit(1))
    stock = t["inventory"].groupBy(*KEYS["stock"]).agg(count.alias("slots"), _sum("qty_on_hand", QTY).alias("total_on_hand"))
    open_quantity = _sum(F.col("qty_ordered") - F.col("qty_received"), QTY)
    orders = t["po_line"].groupBy("po_id").agg(count.alias("line_count"), open_quantity.alias("qty_outstanding"))
    loads = t["shipment_line"].groupBy("shipment_id").agg(
        count.alias("line_count"), _sum("qty_shipped", QTY).alias("total_qty_shipped")
    )
    return {
        "stock": stock, "orders": orders, "loads": loads,
        "value": _value(_weighed(stock), t),
        "due": _due(_weighed(t["purchase_order"].join(orders, "po_id", "left_semi").select(*_HEADER)), t),
        "en_route": _en_route(_weighed(t["shipment"].join(loads, "shipment_id", "left_semi").select("shipment_id", "so_id", "status")), t),
    }


def after_replay(kept: Tables, result: Replay) -> dict[str, DataFrame]:
    """The kept tables after a batch, from those of the tables it was replayed on.

    The deltas of the first level are written to the shared folder, since several tables are made from each.
    """
    t = result.tables
    accepted = result.accepted()

    slots = result.slot_changes().withColumnsRenamed({"wh": "warehouse_id", "loc": "location_id"})
    held = t["inventory"].select("product_id", "warehouse_id", "location_id", F.lit(0).alias("new"))
    stock_delta = cut(
        slots.join(held, ["product_id", "warehouse_id", "location_id"], "left")
        .groupBy(*KEYS["stock"])
        .agg(
            F.sum(F.coalesce("new", F.lit(1))).cast("bigint").alias("slots"),
            F.sum(quantity("change")).cast(QTY).alias("total_on_hand"),
        ),
        "kept-stock-delta",
    )
    stock = merged(kept["stock"], stock_delta, KEYS["stock"])
    touched = stock_delta.select(*KEYS["stock"])
    stock_rows = _moved(
        kept["stock"].join(touched, KEYS["stock"], "left_semi"), stock.join(touched, KEYS["stock"], "left_semi")
    )

    order_delta = cut(
        accepted.where(kind_is("RECEIVE")).groupBy(F.col("order_id").alias("po_id")).agg(
            F.lit(0).cast("bigint").alias("line_count"), (-F.sum(quantity("milli"))).cast(QTY).alias("qty_outstanding")
        ),
        "kept-order-delta",
    )
    orders = merged(kept["orders"], order_delta, KEYS["orders"])
    was = t["purchase_order"].select(*_HEADER).join(order_delta.select("po_id"), "po_id", "left_semi")
    now_open = orders.select("po_id", "qty_outstanding").join(order_delta.select("po_id"), "po_id", "left_semi")
    status = F.when(F.col("qty_outstanding") == 0, "RECEIVED").otherwise("PARTIAL")
    headers = _moved(was, was.join(now_open, "po_id").withColumn("status", status).select(*_HEADER))

    load_delta = cut(
        result.documents.where(kind_is("SHIP")).groupBy(F.col("document_id").alias("shipment_id")).agg(
            F.count(F.lit(1)).alias("line_count"), F.sum("qty").cast(QTY).alias("total_qty_shipped")
        ),
        "kept-load-delta",
    )
    fresh = load_delta.select("shipment_id").join(kept["loads"], "shipment_id", "left_anti")
    shipments = t["shipment"].unionByName(result.shipment()).select("shipment_id", "so_id", "status")

    deltas = {
        "value": _value(stock_rows, t),
        "due": _due(headers, t),
        "en_route": _en_route(_weighed(shipments.join(fresh, "shipment_id", "left_semi")), t),
    }
    second = {name: merged(kept[name], delta, KEYS[name]) for name, delta in deltas.items()}
    return {"stock": stock, "orders": orders, "loads": merged(kept["loads"], load_delta, KEYS["loads"]), **second}


def after_products(kept: Tables, t: Tables, products: DataFrame) -> dict[str, DataFrame]:
    """The kept tables after a change of the product table: prices, categories, reorder levels, in use or not.

    The stock of products that changed, came or went leaves ``value`` as it counted and enters it as it counts now.
    """
    facts = F.struct(*PRODUCT_FACTS).alias("facts")
    old, new = t["product"].select("product_id", facts), products.select("product_id", facts)
    differ = old.unionAll(new).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("facts").alias("least"), F.max("facts").alias("most")
    ).where((F.col("n") == 1) | ~F.col("least").eqNullSafe(F.col("most"))).select("product_id")
    stock = kept["stock"].join(differ, "product_id", "left_semi")
    value = merged(kept["value"], _value(_weighed(stock, -1), t), KEYS["value"])
    value = merged(value, _value(_weighed(stock), {**_picked(t, "warehouse"), "product": products}), KEYS["value"])
    return {**_picked(kept, *KEYS), "value": value}


def _picked(t: Tables, *names: str) -> dict[str, DataFrame]:
    return {name: t[name] for name in names}


# -- beside a store of versions ----------------------------------------------------


def save(kept: Mapping[str, DataFrame], store: Snapshots, version: int) -> dict[str, DataFrame]:
    """Write the kept tables of a version beside it and read them back; the marker comes last."""
    folder = f"{store.folder}/kept/version={version}"
    with shuffles_removed(store.spark):
        at_once(lambda name: kept[name].write.mode("overwrite").parquet(f"{folder}/{name}"), [*KEYS])
    store.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/whole")
    return _read(store, version, {name: kept[name].schema for name in KEYS})


def _read(store: Snapshots, version: int, schemas_: Mapping) -> dict[str, DataFrame]:
    folder = f"{store.folder}/kept/version={version}"
    return {name: store.spark.read.schema(schemas_[name]).parquet(f"{folder}/{name}") for name in KEYS}


def load(store: Snapshots, version: int | None = None) -> dict[str, DataFrame]:
    """The kept tables of a version (default: the current one); computed and saved where a job was lost before it saved them."""
    version = store.current() if version is None else version
    computed = compute(store.load(version))
    try:
        store.spark.read.parquet(f"{store.folder}/kept/version={version}/whole")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return save(computed, store, version)
    return _read(store, version, {name: computed[name].schema for name in KEYS})


# -- the views from kept tables ----------------------------------------------------


def low_stock(kept: Tables, t: Tables) -> DataFrame:
    return views.low_stock(t, kept["stock"].drop("slots"))


def open_purchase_orders(kept: Tables, t: Tables) -> DataFrame:
    return views.open_purchase_orders(t, kept["orders"])


def stock_valuation(kept: Tables, t: Tables) -> DataFrame:
    return (
        kept["value"]
        .join(t["warehouse"].select("warehouse_id", "warehouse_code", "warehouse_name"), "warehouse_id")
        .join(t["product_category"].select("category_id", "category_name"), "category_id")
        .groupBy("warehouse_code", "warehouse_name", "category_name")
        .agg(
            F.sum("product_count").alias("product_count"),
            F.sum("total_units").cast(QTY).alias("total_units"),
            F.sum("total_cost_value").cast(VALUE).alias("total_cost_value"),
            F.sum("total_retail_value").cast(VALUE).alias("total_retail_value"),
        )
    )


def dashboard_metrics(kept: Tables, t: Tables, as_of: str | Column | None = None) -> DataFrame:
    """The headline figures; reads kept tables, warehouses, categories and products only."""
    late = kept["due"].where(F.col("expected_date") < views.day_of(as_of))
    return reports.figures(
        t,
        stock_valuation(kept, t),
        kept["value"].agg(F.sum("low_stock_count").alias("low_stock_count")),
        kept["en_route"].agg(F.sum("n_shipments").alias("pending_shipments")),
        late.agg(F.sum("n_orders").alias("overdue_pos")),
    )
