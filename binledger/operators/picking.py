"""What the order and transfer screens work out for the user, for whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binledger.operators import reports, views
from binledger.sources.tables import Tables

QTY = views.QTY


def inventory_search(
    t: Tables, term: str = "", warehouse_code: str = "", category_name: str = ""
) -> DataFrame:
    """Slots matching a text and two exact filters; an empty filter matches all.

    The text is looked for anywhere in SKU, product name or bin code, ignoring
    case; ``%`` and ``_`` are ordinary characters.
    """
    rows = reports.inventory_listing(t, ordered=False)
    wanted = term.lower().strip()
    if wanted:
        found = [
            F.lower(c).contains(F.lit(wanted)) for c in ("sku", "product_name", "location_code")
        ]
        rows = rows.where(found[0] | found[1] | found[2])
    if warehouse_code:
        rows = rows.where(F.col("warehouse_code") == warehouse_code)
    if category_name:
        rows = rows.where(F.col("category_name") == category_name)
    return rows


def category_values(t: Tables) -> DataFrame:
    """Names of the categories that have a product."""
    used = t["product"].select("category_id").distinct()
    return (
        t["product_category"].join(used, "category_id", "left_semi").select("category_name").distinct()
    )


def locations_of_warehouse(t: Tables, warehouse_id: int) -> DataFrame:
    return reports.active_locations(t).where(F.col("warehouse_id") == warehouse_id)


def available() -> Column:
    """Free quantity of a slot row, never negative, 0 where there is no row."""
    free = F.col("qty_on_hand") - F.col("qty_reserved")
    return F.greatest(F.coalesce(free, F.lit(0)), F.lit(0)).cast(QTY)


def _free_stock(t: Tables) -> DataFrame:
    return t["inventory"].select(
        "product_id", "warehouse_id", "location_id", available().alias("available")
    )


def _active_bins(t: Tables) -> DataFrame:
    return views.active(t["warehouse_location"]).select("warehouse_id", "location_id")


def transfer_requests(t: Tables) -> DataFrame:
    """Transfer lines as requests: which product, from where, to where, how much."""
    headers = t["stock_transfer"].select("transfer_id", "from_warehouse_id", "to_warehouse_id")
    return t["stock_transfer_line"].join(headers, "transfer_id").select(
        F.col("transfer_line_id").alias("request_id"), "product_id",
        F.col("from_warehouse_id").alias("warehouse_id"),
        F.col("from_location_id").alias("location_id"),
        "to_warehouse_id", "to_location_id", F.col("qty_requested").alias("qty"),
    )


def available_by_bin(t: Tables, requests: DataFrame) -> DataFrame:
    """For each requested (product, warehouse): every active bin and what is free in it."""
    pairs = requests.select("product_id", "warehouse_id").distinct()
    return (
        pairs.join(_active_bins(t), "warehouse_id")
        .join(_free_stock(t), ["product_id", "warehouse_id", "location_id"], "left")
        .select(
            "product_id", "warehouse_id", "location_id",
            F.coalesce("available", F.lit(0)).cast(QTY).alias("available"),
        )
    )


def best_source_bin(t: Tables, requests: DataFrame) -> DataFrame:
    """For each request the active bin with most free stock, the lowest id on a tie.

    The best bin is found once per (product, warehouse), before the requests are
    joined. NULL where nothing is free.
    """
    best = (
        _free_stock(t)
        .where(F.col("available") > 0)
        .join(_active_bins(t), ["warehouse_id", "location_id"], "left_semi")
        .groupBy("product_id", "warehouse_id")
        .agg(F.max(F.struct("available", (-F.col("location_id")).alias("minus_id"))).alias("top"))
        .select(
            "product_id", "warehouse_id",
            (-F.col("top.minus_id")).alias("best_location_id"),
            F.col("top.available").alias("available"),
        )
    )
    return requests.join(best, ["product_id", "warehouse_id"], "left").select(
        "request_id", "product_id", "warehouse_id", "best_location_id",
        F.coalesce("available", F.lit(0)).cast(QTY).alias("available"),
    )


def default_destination_bin(t: Tables, requests: DataFrame) -> DataFrame:
    """For each request the first active bin of the target warehouse.

    Within one warehouse that has a second bin, the source bin is passed over. The
    two lowest bin ids per warehouse decide every case.
    """
    rank = F.row_number().over(Window.partitionBy("warehouse_id").orderBy("location_id"))
    lowest = _active_bins(t).withColumn("rank", rank).where(F.col("rank") <= 2)
    per_warehouse = lowest.groupBy(F.col("warehouse_id").alias("to_warehouse_id")).agg(
        F.min(F.when(F.col("rank") == 1, F.col("location_id"))).alias("first_bin"),
        F.min(F.when(F.col("rank") == 2, F.col("location_id"))).alias("second_bin"),
    )
    blocked = (
        (F.col("warehouse_id") == F.col("to_warehouse_id"))
        & (F.col("first_bin") == F.col("location_id"))
        & F.col("second_bin").isNotNull()
    )
    return requests.join(per_warehouse, "to_warehouse_id", "left").select(
        "request_id", "warehouse_id", "location_id", "to_warehouse_id",
        F.when(blocked, F.col("second_bin")).otherwise(F.col("first_bin")).alias(
            "default_location_id"
        ),
    )


def line_progress(t: Tables) -> DataFrame:
    """Open quantity of every order line, and whether it is done."""

    def side(table: str, kind: str, line: str, header: str, done: str) -> DataFrame:
        remaining = (F.col("qty_ordered") - F.col(done)).cast(QTY)
        return t[table].select(
            F.lit(kind).alias("kind"), F.col(line).alias("line_id"),
            F.col(header).alias("header_id"), remaining.alias("remaining"),
            F.when(remaining > 0, "OPEN").otherwise("FULFILLED").alias("progress"),
        )

    return side("po_line", "PURCHASE", "po_line_id", "po_id", "qty_received").unionAll(
        side("so_line", "SALES", "so_line_id", "so_id", "qty_shipped")
    )


def transfer_feasibility(t: Tables, requests: DataFrame) -> DataFrame:
    """Why a transfer request could not be sent off, or OK; the first reason counts."""
    same_bin = (F.col("warehouse_id") == F.col("to_warehouse_id")) & (
        F.col("location_id") == F.col("to_location_id")
    )
    free = F.coalesce("available", F.lit(0))
    verdict = (
        F.when(F.col("location_id").isNull() | F.col("to_location_id").isNull(), "MISSING_BIN")
        .when(same_bin, "SAME_BIN")
        .when(F.col("qty").isNull() | (F.col("qty") <= 0), "BAD_QUANTITY")
        .when(free <= 0, "NOTHING_AVAILABLE")
        .when(F.col("qty") > free, "NOT_ENOUGH")
        .otherwise("OK")
    )
    slot = ["product_id", "warehouse_id", "location_id"]
    return requests.join(_free_stock(t), slot, "left").select(
        "request_id", *slot, "to_warehouse_id", "to_location_id", "qty",
        free.cast(QTY).alias("available"), verdict.alias("verdict"),
    )


def filled_quantity(free: Column, entered: Column) -> Column:
    """The quantity a transfer form settles on, given what is free and what was typed."""
    invalid = entered.isNull() | (entered > free) | (entered <= 0)
    at_least_one = F.greatest(F.lit(1), F.coalesce(entered, F.lit(1)))
    return F.when((free > 0) & invalid, F.least(free, at_least_one)).otherwise(entered)


def default_transfer_quantity(t: Tables, requests: DataFrame) -> DataFrame:
    slot = ["product_id", "warehouse_id", "location_id"]
    free = F.coalesce("available", F.lit(0)).cast(QTY)
    return requests.join(_free_stock(t), slot, "left").select(
        "request_id", *slot, "qty", free.alias("available"),
        filled_quantity(free, F.col("qty")).cast(QTY).alias("default_qty"),
    )


def default_line_quantity(t: Tables) -> DataFrame:
    """The quantity a receive or ship form starts with: all that is left."""
    return line_progress(t).select("kind", "line_id", F.col("remaining").alias("default_qty"))
