"""Every operator as a named query over a folder of source parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binledger import schemas
from binledger.operators import integrity, kept, keys, lookups, movements, picking, reports, views
from binledger.plans.portable import portable
from binledger.session import cut, ensure_checkpoint_dir
from binledger.sources import tables as loading
from binledger.sources.snapshots import DECISIONS, Snapshots
from binledger.sources.testdata import DerivedTables, FaultyTables, UncleanTables
from binledger.streaming import movements as streaming

AS_OF = "1998-07-01"
NOW = "2002-01-01 00:00:00"

# look-up -> key values (and, where dated, the month asked for)
LOOKUP_VALUES: dict[str, tuple[tuple, dict]] = {
    "employees_by_department": ((1,), {}),
    "products_by_category": ((3,), {}),
    "products_by_name": (("red ring",), {}),
    "bins_by_warehouse": ((2,), {}),
    "stock_by_product": ((42,), {}),
    "stock_by_warehouse": ((3,), {}),
    "stock_by_bin": ((7,), {}),
    "stock_by_product_warehouse": ((42, 1), {}),
    "purchase_orders_by_supplier_status": ((5, "APPROVED"), {}),
    "purchase_orders_by_warehouse": ((1,), {}),
    "po_lines_by_product": ((42,), {}),
    "receipts_by_order": ((5,), {}),
    "receipt_lines_by_receipt": ((5,), {}),
    "receipt_lines_by_po_line": ((500001,), {}),
    "sales_orders_by_customer_status": ((5, "SHIPPED"), {}),
    "sales_orders_by_warehouse": ((1,), {}),
    "so_lines_by_product": ((42,), {}),
    "shipments_by_order_status": ((4, "PENDING"), {}),
    "shipment_lines_by_shipment": ((4,), {}),
    "shipment_lines_by_so_line": ((400001,), {}),
    "transfers_by_source_status": ((2, "IN_TRANSIT"), {}),
    "transfers_by_target_status": ((2, "REQUESTED"), {}),
    "transfer_lines_by_transfer": ((8,), {}),
    "transfer_lines_by_product": ((42,), {}),
    "movements_by_product": ((42,), {}),
    "movements_by_warehouse": ((1,), {}),
    "movements_by_warehouse_type": ((1, "ISSUE"), {"start": "1998-07-01", "end": "1998-08-01"}),
    "movements_by_reference": (("SHIPMENT", 42), {}),
}

Query = Callable[[SparkSession, str], DataFrame]


def _on(build: Callable[[DerivedTables], DataFrame], source=DerivedTables, written: bool = False) -> Query:
    """``written`` for queries that read many of the derived tables, or some of them many times."""
    return lambda spark, folder: portable(build(source(spark, folder, written)))


def _exploded(nested: DataFrame, *line_columns: str) -> DataFrame:
    """One row per line of a nested listing, a header without lines once with NULLs."""
    headers = [c for c in nested.columns if c not in ("lines", "page")]
    line = F.explode_outer("lines").alias("line")
    return nested.select(*headers, line).select(
        *headers, *[F.col(f"line.{c}").alias(f"line_{c}" if c in headers else c) for c in line_columns]
    )


def _replayed(t: DerivedTables) -> movements.Replay:
    return movements.replay(
        t.movement_command, t, F.lit(NOW).cast("timestamp")
    )


def _outcomes(t: DerivedTables) -> DataFrame:
    accepted = F.col("code") == 0
    return movements.outcomes(t.movement_command, t).select(
        "seq", "cmd", movements.reason_name().alias("outcome"),
        F.when(accepted, F.col("src_before") / 1000).alias("qty_before"),
    )


def _replayed_twice(t: DerivedTables) -> DataFrame:
    """Half the script replayed and committed, the rest replayed on the version read back."""
    script = cut(t.movement_command, "script")
    half = script.agg((F.max("seq") / 2).cast("bigint")).scalar()
    store = _new_store(t)
    now = F.lit(NOW).cast("timestamp")
    for part in (script.where(F.col("seq") <= half), script.where(F.col("seq") > half)):
        movements.commit_replay(movements.replay(part, store.load(), now), store)
    return _decisions(store)


def _kept_views(t: DerivedTables) -> DataFrame:
    """Views of aggregates that two halves of the script moved on, each from what the store kept of the version before."""
    script = cut(t.movement_command, "script")
    half = script.agg((F.max("seq") / 2).cast("bigint")).scalar()
    store, now = _new_store(t), F.lit(NOW).cast("timestamp")
    held = kept.load(store)
    for part in (script.where(F.col("seq") <= half), script.where(F.col("seq") > half)):
        result = movements.replay(part, store.load(), now)
        held = kept.save(kept.after_replay(held, result), store, movements.commit_replay(result, store))
    after, empty = store.load(), F.lit(None)

    def rows(view: str, df: DataFrame, place, item, count, quantity, cost=empty, retail=empty) -> DataFrame:
        return df.select(
            F.lit(view).alias("view"), place.alias("place"), item.alias("item"), count.cast("bigint").alias("number"),
            quantity.cast("decimal(18,3)").alias("quantity"), cost.cast("decimal(24,5)").alias("cost"),
            retail.cast("decimal(24,5)").alias("retail"),
        )

    low, to_come = kept.low_stock(held, after), kept.open_purchase_orders(held, after)
    worth, figures = kept.stock_valuation(held, after), kept.dashboard_metrics(held, after, AS_OF)
    c = F.col
    totals = (c("total_units"), c("total_cost_value"), c("total_retail_value"))
    return reduce(DataFrame.unionAll, [
        rows("low stock", low, c("warehouse_code"), c("sku"), empty, c("total_on_hand")),
        rows("to come", to_come, c("status"), c("po_number"), c("line_count"), c("qty_outstanding")),
        rows("worth", worth, c("warehouse_code"), c("category_name"), c("product_count"), *totals),
        rows("short", figures, empty, empty, c("low_stock_count"), *totals),
        rows("late", figures, empty, empty, c("overdue_pos"), empty),
        rows("on the way", figures, empty, empty, c("pending_shipments"), empty),
    ])


def _repriced(t: DerivedTables) -> DataFrame:
    """Valuation after a change of products: prices, categories, reorder levels, and some no longer in use."""
    key = F.col("product_id")
    products = t["product"].withColumns({
        "unit_price": (F.col("unit_price") + F.when(key % 2 == 0, 1).otherwise(0)).cast("decimal(12,2)"),
        "category_id": F.when(key % 5 == 0, 1).otherwise(F.col("category_id")),
        "reorder_level": F.when(key % 3 == 0, 9999).otherwise(F.col("reorder_level")).cast("decimal(10,3)"),
        "is_active": F.when(key % 7 == 0, "N").otherwise("Y"),
    })
    stored = {name: cut(df, f"kept-{name}") for name, df in kept.compute(t).items()}
    after = kept.after_products(stored, t, products)
    return kept.dashboard_metrics(after, {**dict(t), "product": products}, AS_OF)


def _new_store(t: DerivedTables) -> Snapshots:
    store = Snapshots(t.spark, f"{ensure_checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}")
    store.create(t)
    return store


def _decisions(store: Snapshots) -> DataFrame:
    return store.load()[DECISIONS].select(
        "seq", "cmd", F.col("reason").alias("outcome"),
        F.when(F.col("code") == 0, F.col("src_before") / 1000).alias("qty_before"),
    )


def _streamed(t: DerivedTables) -> Snapshots:
    """The script as a stream in three runs, each picking up at the checkpoint of the one before."""
    script, store = cut(t.movement_command, "script"), _new_store(t)
    top = script.agg(F.max("seq")).scalar()
    source, now = f"{store.folder}/arriving", F.lit(NOW).cast("timestamp")
    for i in range(3):
        part = script.where((F.col("seq") * 3 > top * i) & (F.col("seq") * 3 <= top * (i + 1)))
        part.write.mode("append").parquet(source)
        commands = t.spark.readStream.schema(script.schema).parquet(source)
        streaming.start(commands, store, "script", f"{store.folder}/checkpoint", now).awaitTermination()
    return store


def _streamed_ledger(t: DerivedTables) -> DataFrame:
    store = _streamed(t)
    top = t["stock_transaction"].agg(F.max("transaction_id")).scalar()
    return store.load()["stock_transaction"].where(F.col("transaction_id") > top).select(
        "transaction_id", "product_id", "warehouse_id", "location_id", "transaction_type", "qty_change", "qty_before",
        "qty_after", "reference_type", "reference_id", "employee_id", "notes",
    )


def _hot_outcomes(t: DerivedTables) -> DataFrame:
    return movements.outcomes(t.hot_command, t).select(
        "seq", "cmd", movements.reason_name().alias("outcome"),
        F.when(F.col("code") == 0, F.col("src_before") / 1000).alias("qty_before"),
    )


def _chain_in_halves(t: DerivedTables) -> DataFrame:
    """The altered log checked in two parts, the second from the balances carried over from the first."""
    log = cut(_altered(t["stock_transaction"]).select(
        "transaction_id", "product_id", "warehouse_id", "location_id", "qty_change", "qty_before", "qty_after"
    ), "altered-log")
    half = log.agg((F.max("transaction_id") / 2).cast("bigint")).scalar()
    old, new = log.where(F.col("transaction_id") <= half), log.where(F.col("transaction_id") > half)
    carried = integrity.ledger_balances(old)
    return integrity.ledger_chain_check(old).unionAll(integrity.ledger_chain_check(new, carried=carried))


def _merged(t: DerivedTables) -> DataFrame:
    """Three numbered changes of every product; the last deletes every seventh, and every tenth is a new product."""
    key = F.col("product_id")
    product = t["product"]
    numbers = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("change_number")
    changes = product.select("product_id", "category_id", "sku", numbers).select(
        F.when(key % 10 == 3, key + (1 << 40)).otherwise(key).alias("product_id"), "category_id", "sku",
        F.col("change_number").cast("decimal(12,2)").alias("unit_price"), "change_number",
        ((F.col("change_number") == 3) & (key % 7 == 0)).alias("gone"),
    )
    merged = keys.upsert(product, changes, "product_id", F.lit(NOW).cast("timestamp"), "change_number", "gone")
    return merged.select("product_id", "category_id", "sku", "unit_price", "updated_at")


def _inbound_ledger(t: DerivedTables) -> DataFrame:
    result = movements.replay(
        t.inbound_command, t, F.lit(NOW).cast("timestamp")
    )
    return result.ledger().select(
        "transaction_id", "product_id", "warehouse_id", "location_id", "transaction_type",
        "qty_change", "qty_before", "qty_after",
    )


def _altered(log: DataFrame) -> DataFrame:
    """The whole log with some balances changed, as input for the chain check."""
    key = F.col("transaction_id")
    return log.withColumns(
        {
            "qty_after": F.col("qty_after") + F.when(key % 97 == 11, 5).otherwise(0),
            "qty_before": F.col("qty_before") - F.when(key % 89 == 7, 2).otherwise(0),
        }
    )


#: Headers asked to be deleted, for each of the five that cascade to lines.
ASKED = {
    "purchase_order": "status IN ('CANCELLED', 'RECEIVED')",
    "sales_order": "status <> 'SHIPPED'",
    "goods_receipt": "reason_code = 'STANDARD'",
    "shipment": "status = 'PENDING'",
    "stock_transfer": "status = 'CANCELLED'",
}


def _cascade(t: DerivedTables) -> DataFrame:
    found = []
    for header, test in ASKED.items():
        line, key = schemas.CASCADES[header]
        done = integrity.cascade_delete(t, header, t[header].where(test).select(key))
        keys = {"refused": key, "deleted": key, "deleted_lines": schemas.PRIMARY_KEY[line]}
        found += [
            done[name].select(F.lit(header).alias("header"), F.lit(name).alias("result"), F.col(k).alias("id"))
            for name, k in keys.items()
        ]
    return reduce(DataFrame.unionAll, found)


def _raw_products(t: DerivedTables) -> DataFrame:
    """Product rows as text with gaps and faults, as a loader receives them."""
    key = F.col("p_partkey")
    return t.raw("part").select(
        key.cast("string").alias("product_id"),
        F.when(key % 17 != 0, "1").alias("category_id"),
        F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"),
        F.col("p_name").alias("product_name"),
        F.when(key % 3 == 0, "BOX").alias("unit_of_measure"),
        F.when(key % 19 == 0, "n/a").when(key % 5 != 0, F.col("p_size").cast("string")).alias(
            "unit_cost"
        ),
        F.when(key % 7 == 0, "N").alias("is_active"),
    )


def _ingested(t: DerivedTables, part: int) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    result = loading.ingest("product", _raw_products(t), now)[part]
    if part == 1:
        return result.select("product_id", F.array_join("faults", ",").alias("faults"))
    return result


def _line_totals(t: DerivedTables) -> DataFrame:
    def side(kind: str, table: str, unit: str) -> DataFrame:
        lines = loading.with_line_total(t[table].drop("line_total"), unit)
        key = schemas.PRIMARY_KEY[table]
        return lines.select(F.lit(kind).alias("kind"), F.col(key).alias("line_id"), "line_total")

    return side("PURCHASE", "po_line", "unit_cost").unionAll(side("SALES", "so_line", "unit_price"))


def _keyed(t: DerivedTables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.raw("orders").select(
        (key + 1).alias("load_position"), F.when(key % 3 == 0, key).alias("receipt_id")
    )
    return keys.assign_surrogate_keys(rows, "receipt_id", "load_position")


def _upserted(t: DerivedTables) -> DataFrame:
    """Prices of active products rise by one; every tenth product is new."""
    shift = 1 << 40
    product = t["product"]
    raised = product.where(F.col("is_active") == "Y").select(
        "product_id", "category_id", "sku",
        (F.col("unit_price") + F.when(F.col("product_id") % 2 == 0, 1).otherwise(0))
        .cast("decimal(12,2)")
        .alias("unit_price"),
    )
    new = product.where(F.col("product_id") % 10 == 3).select(
        (F.col("product_id") + shift).alias("product_id"), "category_id",
        F.concat("sku", F.lit("-NEW")).alias("sku"), "unit_price",
    )
    merged = keys.upsert(
        product, raised.unionAll(new), "product_id", F.lit(NOW).cast("timestamp")
    )
    return merged.select("product_id", "category_id", "sku", "unit_price", "updated_at")


def _resolved(t: DerivedTables) -> DataFrame:
    line = t.raw("lineitem")
    bin_id = F.col("l_suppkey") % 25
    coded = line.select(
        F.concat(F.lit("SKU-"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("sku"),
        F.concat(F.lit("WH-"), bin_id % 5).alias("warehouse_code"),
        F.concat(F.lit("NATION_"), bin_id).alias("location_code"),
        F.col("l_quantity").cast("decimal(12,3)").alias("qty_on_hand"),
    )
    return keys.resolve_natural_keys(t, coded, ["sku", "warehouse_code", "location_code"]).select(
        "product_id", "warehouse_id", "location_id", "qty_on_hand"
    )


def _user_sql(spark: SparkSession, folder: str) -> DataFrame:
    loading.register_views(spark, DerivedTables(spark, folder), AS_OF)
    return portable(
        spark.sql(
            "SELECT warehouse_code, count(*) AS slots, sum(stock_value) AS stock_value "
            "FROM v_inventory_by_warehouse GROUP BY warehouse_code"
        )
    )


def _totals(t: DerivedTables) -> DataFrame:
    def side(kind: str, header: str, key: str) -> DataFrame:
        return keys.header_totals(t, header).select(
            F.lit(kind).alias("kind"), F.col(key).alias("header_id"), "total_amount"
        )

    return side("PURCHASE", "purchase_order", "po_id").unionAll(side("SALES", "sales_order", "so_id"))


def _status_changes(t: DerivedTables) -> DataFrame:
    result = _replayed(t)
    purchase = result.purchase_order().select(
        F.lit("PURCHASE").alias("kind"), F.col("po_id").alias("header_id"), "status", "updated_at"
    )
    sales = result.sales_order().select(
        F.lit("SALES").alias("kind"), F.col("so_id").alias("header_id"), "status", "updated_at"
    )
    return purchase.unionAll(sales)


def _documents(t: DerivedTables) -> DataFrame:
    result = _replayed(t)
    return result.documents.select(
        "seq", "cmd", "document_id", "transfer_number",
    )


def _movement_ledger(t: DerivedTables) -> DataFrame:
    return _replayed(t).ledger().select(
        "transaction_id", "seq", "leg", "product_id", "warehouse_id", "location_id",
        "transaction_type", "qty_change", "qty_before", "qty_after", "reference_type",
        "reference_id", "employee_id", "notes",
    )


def _movement_inventory(t: DerivedTables) -> DataFrame:
    return _replayed(t).inventory().select(
        "inventory_id", "product_id", "warehouse_id", "location_id", "qty_on_hand",
        "qty_reserved", "updated_at",
    )


def _movement_receipts(t: DerivedTables) -> DataFrame:
    result = _replayed(t)
    return result.goods_receipt_line().join(
        result.goods_receipt().select(
            "receipt_id", "receipt_number", "po_id", "receipt_date", "received_by", "reason_code"
        ),
        "receipt_id",
    )


def _movement_shipments(t: DerivedTables) -> DataFrame:
    result = _replayed(t)
    return result.shipment_line().join(
        result.shipment().select(
            "shipment_id", "shipment_number", "so_id", "carrier", "tracking_number", "status",
            "shipped_by",
        ),
        "shipment_id",
    )


def _movement_transfers(t: DerivedTables) -> DataFrame:
    result = _replayed(t)
    return result.stock_transfer_line().join(
        result.stock_transfer().select(
            "transfer_id", "transfer_number", "from_warehouse_id", "to_warehouse_id", "status",
            "requested_by", "notes",
        ),
        "transfer_id",
    )


def _script(t: DerivedTables) -> DataFrame:
    """The script's transfers as requests for the transfer screen."""
    return t.movement_command.where(F.col("cmd") == "TRANSFER").select(
        F.col("seq").alias("request_id"), "product_id", "warehouse_id", "location_id",
        "to_warehouse_id", "to_location_id", "qty",
    )


_LINE = ("sku", "product_name", "unit_of_measure")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        # sources
        **{
            f"q_table_{name}": _on(lambda t, name=name: t[name])
            for name in schemas.TABLE_DDL
        },
        "q_movement_script": _on(
            lambda t: t.movement_command.select(*schemas.movement_schema().fieldNames()[:10])
        ),
        "q_line_totals": _on(_line_totals),
        "q_ingest_products": _on(lambda t: _ingested(t, 0)),
        "q_ingest_rejects": _on(lambda t: _ingested(t, 1)),
        "q_user_sql": _user_sql,
        # reporting views
        "q_inventory_by_warehouse": _on(views.inventory_by_warehouse),
        "q_low_stock": _on(views.low_stock),
        "q_open_purchase_orders": _on(views.open_purchase_orders),
        "q_stock_valuation": _on(views.stock_valuation),
        "q_pending_shipments": _on(views.pending_shipments),
        "q_overdue_purchase_orders": _on(
            lambda t: views.overdue_purchase_orders(t, AS_OF, ordered=True)
        ),
        # read endpoints
        "q_dashboard_metrics": _on(lambda t: reports.dashboard_metrics(t, AS_OF)),
        "q_recent_transactions": _on(reports.recent_transactions),
        "q_transactions": _on(reports.transactions),
        "q_inventory_listing": _on(reports.inventory_listing),
        "q_products": _on(reports.products),
        "q_active_warehouses": _on(reports.active_warehouses),
        "q_active_locations": _on(reports.active_locations),
        "q_purchase_orders_nested": _on(
            lambda t: _exploded(
                reports.purchase_orders_nested(t, ordered=False), "po_line_id", "line_number", "product_id",
                "qty_ordered", "qty_received", "unit_cost", "line_total", *_LINE,
            )
        ),
        "q_sales_orders_nested": _on(
            lambda t: _exploded(
                reports.sales_orders_nested(t, ordered=False), "so_line_id", "line_number", "product_id",
                "qty_ordered", "qty_shipped", "unit_price", "line_total", *_LINE,
            )
        ),
        "q_transfers_nested": _on(
            lambda t: _exploded(
                reports.transfers_nested(t, ordered=False), "transfer_line_id", "product_id", "from_location_id",
                "to_location_id", "qty_requested", "sku", "product_name", "from_location_code",
                "to_location_code",
            )
        ),
        "q_active_employees": _on(reports.active_employees),
        "q_latest_audit_20": _on(reports.latest_audit),
        "q_audit_by_date": _on(reports.audit_by_date),
        # screens
        "q_inventory_search": _on(lambda t: picking.inventory_search(t, " RinG ", "WH-1", "SMALL")),
        "q_category_values": _on(picking.category_values),
        "q_locations_of_warehouse": _on(lambda t: picking.locations_of_warehouse(t, 1)),
        "q_available_by_bin": _on(
            lambda t: picking.available_by_bin(t, picking.transfer_requests(t))
        ),
        "q_best_source_bin": _on(
            lambda t: picking.best_source_bin(t, picking.transfer_requests(t))
        ),
        "q_default_destination_bin": _on(
            lambda t: picking.default_destination_bin(t, picking.transfer_requests(t))
        ),
        "q_line_progress": _on(picking.line_progress),
        "q_transfer_feasibility": _on(lambda t: picking.transfer_feasibility(t, _script(t))),
        "q_default_transfer_qty": _on(lambda t: picking.default_transfer_quantity(t, _script(t))),
        "q_default_line_qty": _on(picking.default_line_quantity),
        # integrity
        "q_pk_violations": _on(integrity.primary_key_violations, UncleanTables),
        "q_unique_violations": _on(integrity.unique_key_violations, UncleanTables),
        "q_fk_violations": _on(integrity.foreign_key_violations, UncleanTables, written=True),
        "q_check_violations": _on(integrity.check_violations, UncleanTables),
        "q_check_violations_application": _on(
            lambda t: integrity.check_violations(t, "application"), UncleanTables
        ),
        "q_not_null_violations": _on(integrity.not_null_violations, UncleanTables),
        "q_faulty_primary_keys": _on(integrity.primary_key_violations, FaultyTables, written=True),
        "q_faulty_unique_keys": _on(integrity.unique_key_violations, FaultyTables),
        "q_faulty_references": _on(integrity.foreign_key_violations, FaultyTables),
        "q_faulty_checks": _on(integrity.check_violations, FaultyTables, written=True),
        "q_faulty_checks_application": _on(lambda t: integrity.check_violations(t, "application"), FaultyTables),
        "q_faulty_not_null": _on(integrity.not_null_violations, FaultyTables),
        "q_cascade_delete": _on(_cascade),
        "q_ledger_chain_check": _on(
            lambda t: integrity.ledger_chain_check(_altered(t["stock_transaction"]))
        ),
        "q_ledger_chain_carried": _on(_chain_in_halves),
        # aggregates kept up to date
        "q_kept_views": _on(_kept_views, written=True),
        "q_kept_repriced": _on(_repriced),
        # keys
        "q_upsert_repeated_keys": _on(_merged),
        "q_assign_surrogate_keys": _on(_keyed),
        "q_touch_updated_at": _on(_upserted),
        "q_resolve_natural_keys": _on(_resolved),
        "q_header_totals": _on(_totals),
        # movements
        "q_movement_outcomes": _on(_outcomes, written=True),
        "q_movement_hot": _on(_hot_outcomes, written=True),
        "q_replay_twice": _on(_replayed_twice, written=True),
        "q_stream_equals_batch": _on(lambda t: _decisions(_streamed(t)), written=True),
        "q_stream_ledger": _on(_streamed_ledger, written=True),
        "q_movement_ledger": _on(_movement_ledger, written=True),
        "q_movement_inventory": _on(_movement_inventory, written=True),
        "q_movement_order_status": _on(_status_changes, written=True),
        "q_movement_documents": _on(_documents, written=True),
        "q_movement_receipts": _on(_movement_receipts, written=True),
        "q_movement_shipments": _on(_movement_shipments, written=True),
        "q_movement_transfers": _on(_movement_transfers, written=True),
        "q_inbound_ledger": _on(_inbound_ledger, written=True),
    }
    for name, (values, dates) in LOOKUP_VALUES.items():
        found[f"q_lookup_{name}"] = _on(
            lambda t, n=name, v=values, d=dates: lookups.lookup(t, n, *v, **d)
        )
    return found
