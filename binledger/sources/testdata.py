"""Stock tables derived from TPC-H-like parquet, lazily and in proportion to it.

The rules are listed in FIXTURES.md section 4. All arithmetic is on integers and
decimals so that other engines reproduce it exactly.
"""

from __future__ import annotations

import threading
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binledger import schemas
from binledger.functions.scan import number_rows, running_sums, whole_quotient
from binledger.session import cut

LINES_PER_HEADER = 100_000  # line numbers have five digits
ORDER_SPAN = 1 << 24

_LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
_START = "1995-01-01 00:00:00"

# --- fixed values: columns of the source files --------------------------------
RAW_DDL = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
}


def _pad(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def _quantity(value: Column) -> Column:
    return value.cast("decimal(12,3)")


def _picked(key: Column, *values: str) -> Column:
    """The value at position ``key`` (0-based) of a short list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


class DerivedTables:
    """The 21 tables and a movement script over one folder of source parquet.

    Each attribute is a lazy DataFrame; nothing is read before it is used, and
    columns a query does not need are pruned down to the scan. With ``written``, the numbered source lines and
    what their orders say of them are written to the shared folder at first use: for jobs that read many tables.
    """

    def __init__(self, spark: SparkSession, folder: str, written: bool = False):
        self.spark = spark
        self.folder = folder
        self.written = written
        self._lines: DataFrame | None = None
        self._writing = threading.Lock()  # tables may be asked for in several threads

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_DDL[name]).parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in schemas.TABLE_DDL:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self):
        return iter(schemas.TABLE_DDL)

    def keys(self):
        return schemas.TABLE_DDL.keys()

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        """Select the table's columns in order; absent ones are NULL."""
        present = set(df.columns)
        return df.select(
            *[
                (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schemas.table_schema(name).fields
            ]
        )

    # -- dimensions ---------------------------------------------------------

    @cached_property
    def uom_lookup(self) -> DataFrame:
        """The units that parts are counted in: the first letters of their types."""
        kinds = self.raw("part").select("p_type").distinct()
        named = kinds.groupBy(F.substring("p_type", 1, 3).alias("uom_code")).agg(F.min("p_type").alias("uom_description"))
        return self._typed("uom_lookup", named)

    @cached_property
    def department(self) -> DataFrame:
        """A department per nation."""
        return self._typed(
            "department",
            self.raw("nation").select(
                (F.col("n_nationkey") + 1).alias("department_id"),
                F.col("n_name").alias("department_code"),
                F.concat(F.lit("Department "), "n_name").alias("department_name"),
                F.lit(_START).alias("created_at"),
            ),
        )

    @cached_property
    def employee(self) -> DataFrame:
        """An employee per customer of the source, numbered from 1."""
        key = F.col("c_custkey")
        return self._typed(
            "employee",
            self.raw("customer").select(
                (key + 1).alias("employee_id"),
                (F.col("c_nationkey") + 1).alias("department_id"),
                F.concat(F.lit("E"), key.cast("string")).alias("employee_code"),
                F.initcap("c_mktsegment").alias("first_name"),
                F.substring_index("c_name", "#", -1).alias("last_name"),
                F.concat(F.lit("e"), key.cast("string"), F.lit("@example.test")).alias("email"),
                _picked(key % 3, "Clerk", "Buyer", "Manager").alias("job_title"),
                F.date_add(F.lit("1990-01-01").cast("date"), (key % 1000).cast("int")).alias("hire_date"),
                F.when(key % 11 == 5, "N").otherwise("Y").alias("is_active"),
                F.lit(_START).alias("created_at"),
            ),
        )

    @cached_property
    def product_category(self) -> DataFrame:
        kinds = self.raw("part").select("p_type").distinct()
        return self._typed(
            "product_category",
            number_rows(kinds, [F.substring("p_type", 1, 2)], ["p_type"], "category_id").withColumns(
                {"category_code": F.col("p_type"), "category_name": F.col("p_type")}
            ),
        )

    @cached_property
    def product(self) -> DataFrame:
        part = self.raw("part").join(
            self.product_category.select("category_id", F.col("category_code").alias("p_type")),
            "p_type",
        )
        size = F.col("p_size")
        return self._typed(
            "product",
            part.select(
                F.col("p_partkey").alias("product_id"),
                "category_id",
                F.concat(F.lit("SKU-"), _pad("p_partkey", 10)).alias("sku"),
                F.col("p_name").alias("product_name"),
                F.col("p_brand").alias("description"),
                F.substring("p_type", 1, 3).alias("unit_of_measure"),
                size.alias("unit_cost"),
                F.col("p_retailprice").alias("unit_price"),
                (size * 4).alias("reorder_level"),
                F.when(F.col("p_partkey") % 10 == 7, "N").otherwise("Y").alias("is_active"),
                F.lit(_START).alias("created_at"),
                F.lit(_START).alias("updated_at"),
            ),
        )

    @cached_property
    def supplier(self) -> DataFrame:
        return self._typed(
            "supplier",
            self.raw("supplier").select(
                F.col("s_suppkey").alias("supplier_id"),
                F.concat(F.lit("SUP-"), F.col("s_suppkey")).alias("supplier_code"),
                F.col("s_name").alias("supplier_name"),
                F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("@example.test")).alias("email"),
                F.lit("USA").alias("country"),
                F.lit("Y").alias("is_active"),
                F.lit(_START).alias("created_at"),
                F.lit(_START).alias("updated_at"),
            ),
        )

    @cached_property
    def customer(self) -> DataFrame:
        return self._typed(
            "customer",
            self.raw("customer").select(
                F.col("c_custkey").alias("customer_id"),
                F.concat(F.lit("CUST-"), F.col("c_custkey")).alias("customer_code"),
                F.col("c_name").alias("customer_name"),
                F.lit("USA").alias("country"),
                F.lit("Y").alias("is_active"),
                F.lit(_START).alias("created_at"),
                F.lit(_START).alias("updated_at"),
            ),
        )

    @cached_property
    def warehouse(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self._typed(
            "warehouse",
            self.raw("region").select(
                key.alias("warehouse_id"),
                F.concat(F.lit("WH-"), key).alias("warehouse_code"),
                F.col("r_name").alias("warehouse_name"),
                F.lit("USA").alias("country"),
                (key % 3 + 1).alias("manager_id"),
                F.lit(50000).alias("capacity_units"),
                F.when(key == 4, "N").otherwise("Y").alias("is_active"),
                F.lit(_START).alias("created_at"),
            ),
        )

    @cached_property
    def warehouse_location(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self._typed(
            "warehouse_location",
            self.raw("nation").select(
                key.alias("location_id"),
                F.col("n_regionkey").alias("warehouse_id"),
                F.col("n_name").alias("location_code"),
                _picked(
                    whole_quotient(key, 5) % 5,
                    "STORAGE", "PICKING", "RECEIVING", "SHIPPING", "QUARANTINE",
                ).alias("zone_type"),
                F.when(key.isin(10, 21), "N").otherwise("Y").alias("is_active"),
            ),
        )

    # -- state --------------------------------------------------------------

    @cached_property
    def inventory(self) -> DataFrame:
        kept = (
            self.raw("lineitem")
            .select(
                F.col("l_partkey").alias("product_id"),
                (F.col("l_suppkey") % 25).alias("location_id"),
                _quantity(F.col("l_quantity")).alias("qty"),
                (F.col("l_linestatus") == "O").alias("open"),
                F.col("l_shipdate").cast("date").alias("day"),
            )
        )
        slots = kept.groupBy("product_id", "location_id").agg(
            F.sum("qty").alias("qty_on_hand"),
            F.sum(F.when(F.col("open"), F.col("qty")).otherwise(_quantity(F.lit(0)))).alias(
                "qty_reserved"
            ),
            F.max("day").alias("last_count_date"),
        )
        return self._typed(
            "inventory",
            slots.withColumns(
                {
                    "inventory_id": F.col("product_id") * 25 + F.col("location_id") + 1,
                    "warehouse_id": F.col("location_id") % 5,
                    "updated_at": F.col("last_count_date").cast("timestamp"),
                }
            ),
        )

    # -- order lines --------------------------------------------------------

    def _raw_lines(self) -> DataFrame:
        """Source lines with a line number per order, which has fewer than ``LINES_PER_HEADER``."""
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
        return self.raw("lineitem").withColumns(
            {"line_number": place.cast("bigint"), "ship_day": F.col("l_shipdate").cast("date")}
        )

    def _sequenced(self, lines: DataFrame) -> DataFrame:
        return number_rows(
            lines, [F.col("ship_day"), whole_quotient(F.col("l_orderkey"), ORDER_SPAN)], ["l_orderkey", "line_number"], "seq"
        )

    def _written_lines(self) -> DataFrame:
        """Numbered lines in shipping order with the status and priority of their order, and those of ``others`` with its key."""
        with self._writing:
            if self._lines is None:
                said = F.collect_list(F.struct("o_orderstatus", "o_orderpriority")).alias("said")
                orders = self.raw("orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(said)
                lines = self._raw_lines().join(orders, "l_orderkey", "left").select(
                    "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "line_number", "ship_day",
                    F.col("said").isNotNull().alias("ordered"), F.col("said")[0].alias("first"),
                    F.when(F.size("said") > 1, F.slice("said", 2, F.size("said"))).alias("others"),
                ).select("*", "first.*").drop("first")
                self._lines = cut(self._sequenced(lines), "source-lines")
            return self._lines

    def _with_ids(self, lines: DataFrame) -> DataFrame:
        quantity = F.col("l_quantity").cast("bigint")
        cents = (F.col("l_extendedprice").cast("decimal(14,2)") * 100).cast("bigint")
        return lines.withColumns(
            {
                "line_id": F.when(
                    F.col("line_number") < LINES_PER_HEADER,
                    F.col("l_orderkey") * LINES_PER_HEADER + F.col("line_number"),
                ).otherwise(F.raise_error(F.lit("an order has more lines than line numbers have digits"))),
                "quantity": quantity,
                "unit_cents": F.call_function("div", cents, quantity),
            }
        )

    @cached_property
    def _numbered_lines(self) -> DataFrame:
        """Source lines with a line number per order and the ids built on it."""
        return self._with_ids(self._written_lines().drop("seq") if self.written else self._raw_lines())

    def _money(self, cents: Column) -> Column:
        return (cents.cast("decimal(14,0)") / F.lit(100)).cast("decimal(12,2)")

    def _lines_with(self, column: str) -> DataFrame:
        """Numbered lines with a column of their orders."""
        lines = self._numbered_lines
        if not self.written:
            return lines.join(self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), column), "l_orderkey")
        others = F.coalesce(F.transform("others", lambda o: o[column]), F.array().cast("array<string>"))
        return lines.where("ordered").withColumn(column, F.explode(F.concat(F.array(column), others)))

    def _done(self, all_when: Column, half_when: Column) -> Column:
        quantity = F.col("quantity")
        return (
            F.when(all_when, quantity)
            .when(half_when, whole_quotient(quantity, 2))
            .otherwise(F.lit(0))
        )

    @cached_property
    def so_line(self) -> DataFrame:
        status = F.col("o_orderstatus")
        lines = self._lines_with("o_orderstatus")
        price = self._money(F.col("unit_cents"))
        return self._typed(
            "so_line",
            lines.select(
                F.col("line_id").alias("so_line_id"),
                F.col("l_orderkey").alias("so_id"),
                "line_number",
                F.col("l_partkey").alias("product_id"),
                F.col("quantity").alias("qty_ordered"),
                self._done(status == "F", status == "P").alias("qty_shipped"),
                price.alias("unit_price"),
                (_quantity(F.col("quantity")) * price).alias("line_total"),
            ),
        )

    @cached_property
    def po_line(self) -> DataFrame:
        rank = F.substring("o_orderpriority", 1, 1)
        lines = self._lines_with("o_orderpriority")
        cost = self._money(whole_quotient(F.col("unit_cents"), 2))
        return self._typed(
            "po_line",
            lines.select(
                F.col("line_id").alias("po_line_id"),
                F.col("l_orderkey").alias("po_id"),
                "line_number",
                F.col("l_partkey").alias("product_id"),
                F.col("quantity").alias("qty_ordered"),
                self._done(rank == "4", rank == "3").alias("qty_received"),
                cost.alias("unit_cost"),
                (_quantity(F.col("quantity")) * cost).alias("line_total"),
            ),
        )

    # -- order headers ------------------------------------------------------

    @cached_property
    def _orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.raw("orders").withColumns(
            {
                "order_date": F.col("o_orderdate").cast("date"),
                "stamp": F.col("o_orderdate").cast("timestamp"),
                "warehouse_id": key % 5,
                "created_by": F.when(key % 4 != 3, key % 3 + 1),
                "total_amount": F.col("o_totalprice").cast("decimal(14,2)"),
            }
        )

    @cached_property
    def sales_order(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self._typed(
            "sales_order",
            self._orders.select(
                F.col("o_orderkey").alias("so_id"),
                F.concat(F.lit("SO-"), _pad("o_orderkey", 10)).alias("so_number"),
                F.col("o_custkey").alias("customer_id"),
                "warehouse_id",
                "order_date",
                F.date_add("order_date", 5).alias("required_date"),
                F.when(status == "O", "CONFIRMED")
                .when(status == "P", "PARTIAL")
                .otherwise("SHIPPED")
                .alias("status"),
                "total_amount",
                "created_by",
                F.col("stamp").alias("created_at"),
                F.col("stamp").alias("updated_at"),
            ),
        )

    @cached_property
    def purchase_order(self) -> DataFrame:
        key = F.col("o_orderkey")
        rank = F.substring("o_orderpriority", 1, 1)
        return self._typed(
            "purchase_order",
            self._orders.select(
                key.alias("po_id"),
                F.concat(F.lit("PO-"), _pad("o_orderkey", 10)).alias("po_number"),
                whole_quotient(F.col("o_custkey"), 15).alias("supplier_id"),
                "warehouse_id",
                "order_date",
                F.when(key % 13 != 0, F.date_add("order_date", 14)).alias("expected_date"),
                F.when(rank == "1", "APPROVED")
                .when(rank == "2", "SUBMITTED")
                .when(rank == "3", "PARTIAL")
                .when(rank == "4", "RECEIVED")
                .when(key % 2 == 0, "DRAFT")
                .otherwise("CANCELLED")
                .alias("status"),
                "total_amount",
                "created_by",
                F.col("stamp").alias("created_at"),
                F.col("stamp").alias("updated_at"),
            ),
        )

    # -- receipts, shipments, transfers -------------------------------------

    @cached_property
    def goods_receipt(self) -> DataFrame:
        received = self.purchase_order.where(F.col("status").isin("PARTIAL", "RECEIVED"))
        return self._typed(
            "goods_receipt",
            received.select(
                F.col("po_id").alias("receipt_id"),
                F.concat(F.lit("GR-"), _pad("po_id", 10)).alias("receipt_number"),
                "po_id",
                F.date_add("order_date", 7).alias("receipt_date"),
                F.col("created_by").alias("received_by"),
                F.lit("STANDARD").alias("reason_code"),
                "created_at",
            ),
        )

    @cached_property
    def goods_receipt_line(self) -> DataFrame:
        return self._typed(
            "goods_receipt_line",
            self.po_line.where(F.col("qty_received") > 0).select(
                F.col("po_line_id").alias("receipt_line_id"),
                F.col("po_id").alias("receipt_id"),
                "po_line_id",
                "product_id",
                (F.col("product_id") % 25).alias("location_id"),
                "qty_received",
            ),
        )

    @cached_property
    def shipment(self) -> DataFrame:
        key = F.col("so_id")
        sent = self.sales_order.where(F.col("status").isin("PARTIAL", "SHIPPED"))
        return self._typed(
            "shipment",
            sent.select(
                key.alias("shipment_id"),
                F.concat(F.lit("SH-"), _pad("so_id", 10)).alias("shipment_number"),
                key,
                F.date_add("order_date", 3).alias("ship_date"),
                F.when(key % 5 != 0, "FedEx").alias("carrier"),
                F.when(key % 5 != 0, F.concat(F.lit("TRK-"), _pad("so_id", 10), F.lit("-US"))).alias(
                    "tracking_number"
                ),
                _picked(key % 4, "PENDING", "IN_TRANSIT", "DELIVERED", "CANCELLED").alias("status"),
                F.col("created_by").alias("shipped_by"),
                F.when(key % 7 == 0, "URGENT").otherwise("STANDARD").alias("reason_code"),
                "created_at",
            ),
        )

    @cached_property
    def shipment_line(self) -> DataFrame:
        return self._typed(
            "shipment_line",
            self.so_line.where(F.col("qty_shipped") > 0).select(
                F.col("so_line_id").alias("shipment_line_id"),
                F.col("so_id").alias("shipment_id"),
                "so_line_id",
                "product_id",
                (F.col("product_id") % 25).alias("location_id"),
                "qty_shipped",
            ),
        )

    @cached_property
    def stock_transfer(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = whole_quotient(key, 2) % 4
        return self._typed(
            "stock_transfer",
            self._orders.select(
                key.alias("transfer_id"),
                F.concat(F.lit("XFR-"), _pad("o_orderkey", 10)).alias("transfer_number"),
                (key % 5).alias("from_warehouse_id"),
                ((key + 1) % 5).alias("to_warehouse_id"),
                F.col("order_date").alias("request_date"),
                _picked(status, "REQUESTED", "IN_TRANSIT", "RECEIVED", "CANCELLED").alias("status"),
                F.col("created_by").alias("requested_by"),
                F.col("stamp").alias("created_at"),
                F.col("stamp").alias("updated_at"),
            ),
        )

    @cached_property
    def stock_transfer_line(self) -> DataFrame:
        row = F.col("l_suppkey") % 5 * 5
        return self._typed(
            "stock_transfer_line",
            self._numbered_lines.select(
                F.col("line_id").alias("transfer_line_id"),
                F.col("l_orderkey").alias("transfer_id"),
                F.col("l_partkey").alias("product_id"),
                (F.col("l_orderkey") % 5 + row).alias("from_location_id"),
                ((F.col("l_orderkey") + 1) % 5 + row).alias("to_location_id"),
                F.col("quantity").alias("qty_requested"),
                F.lit(0).alias("qty_shipped"),
                F.lit(0).alias("qty_received"),
            ),
        )

    # -- log and movement script --------------------------------------------

    @cached_property
    def _sequenced_lines(self) -> DataFrame:
        """Source lines in shipping order, numbered from 1."""
        return self._with_ids(self._written_lines() if self.written else self._sequenced(self._raw_lines()))

    @cached_property
    def stock_transaction(self) -> DataFrame:
        flag = F.col("l_returnflag")
        quantity = F.col("quantity")
        log = self._sequenced_lines.select(
            F.col("seq").alias("transaction_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_suppkey") % 25).alias("location_id"),
            F.when(flag == "A", "RECEIPT").when(flag == "N", "ISSUE").otherwise("ADJUSTMENT").alias(
                "transaction_type"
            ),
            F.when(flag == "N", -quantity).otherwise(quantity).alias("change"),
            F.when(flag == "A", "GOODS_RECEIPT")
            .when(flag == "N", "SHIPMENT")
            .otherwise("CYCLE_COUNT")
            .alias("reference_type"),
            F.when(flag != "R", F.col("l_orderkey")).alias("reference_id"),
            F.when(F.col("l_orderkey") % 4 != 3, F.col("l_orderkey") % 3 + 1).alias("employee_id"),
            F.col("ship_day").cast("timestamp").alias("transaction_date"),
        )
        slots = self.raw("lineitem").select(F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 25).alias("location_id"))
        balanced = running_sums(
            log, ["product_id", "location_id"], ["transaction_id"], {"balance": F.col("change")}, counted=slots,
        )
        return self._typed(
            "stock_transaction",
            balanced.withColumns(
                {
                    "warehouse_id": F.col("location_id") % 5,
                    "qty_change": F.col("change"),
                    "qty_before": F.col("balance") - F.col("change"),
                    "qty_after": F.col("balance"),
                }
            ),
        )

    def _movements(self, cmd: Column, qty: Column) -> DataFrame:
        order, supp, part = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
        on_line = F.col("cmd").isin("RECEIVE", "SHIP")
        transfer = F.col("cmd") == "TRANSFER"
        same_bin = (order % 29 == 0) | (order % 31 == 0)
        row = supp % 5 * 5
        paired = order * LINES_PER_HEADER + whole_quotient(F.col("line_number") + 1, 2)
        lines = self._sequenced_lines.withColumn("cmd", cmd)
        return lines.select(
            "seq",
            "cmd",
            F.when(on_line, F.when(order % 83 == 0, F.lit(-1)).otherwise(paired))
            .cast("bigint")
            .alias("line_id"),
            F.when(~on_line, part).alias("product_id"),
            F.when(~on_line, order % 5).alias("warehouse_id"),
            F.when(order % 79 != 0, order % 5 + row).alias("location_id"),
            F.when(transfer, F.when(order % 31 == 0, order % 5).otherwise((order + 1) % 5)).alias(
                "to_warehouse_id"
            ),
            F.when(transfer, F.when(same_bin, order % 5).otherwise((order + 1) % 5) + row).alias(
                "to_location_id"
            ),
            _quantity(qty).alias("qty"),
            F.when(order % 101 == 0, F.lit(-1)).otherwise(order % 3 + 1).cast("bigint").alias(
                "employee_id"
            ),
            F.lit(None).cast("bigint").alias("header_id"),
            F.lit(None).cast("string").alias("reason_code"),
            F.lit(None).cast("string").alias("carrier"),
            F.lit(None).cast("string").alias("tracking_number"),
            F.lit(None).cast("string").alias("notes"),
        )

    @cached_property
    def movement_command(self) -> DataFrame:
        """Receipts, shipments, adjustments and transfers, many of them to be rejected."""
        flag, quantity = F.col("l_returnflag"), F.col("quantity")
        adjusts = F.col("line_number") % 2 == 0
        cmd = (
            F.when(flag == "A", "RECEIVE")
            .when(flag == "N", "SHIP")
            .when(adjusts, "ADJUST")
            .otherwise("TRANSFER")
        )
        signed = F.when(F.col("cmd") == "ADJUST", -quantity).otherwise(quantity)
        return self._movements(cmd, F.when(F.col("l_orderkey") % 97 == 0, 0).otherwise(signed))

    @cached_property
    def hot_command(self) -> DataFrame:
        """The script with a third of it on one product: adjustments up and down and transfers, near zero stock."""
        seq, hot = F.col("seq"), F.col("seq") % 3 == 0
        turn = whole_quotient(seq, 3)
        warehouse, row = turn % 5, whole_quotient(turn, 5) % 5 * 5
        transfer = hot & (seq % 12 == 0)
        script = self.movement_command
        size = F.abs("qty")
        given = {
            "cmd": F.when(transfer, "TRANSFER").otherwise("ADJUST"),
            "line_id": F.lit(None), "product_id": F.lit(1), "warehouse_id": warehouse, "location_id": warehouse + row,
            "to_warehouse_id": F.when(transfer, (warehouse + 1) % 5), "to_location_id": F.when(transfer, (warehouse + 1) % 5 + row),
            "qty": F.when(~transfer & (turn % 2 == 1), -size).otherwise(size), "employee_id": F.lit(1),
        }
        kinds = {f.name: f.dataType for f in script.schema}
        return script.withColumns({c: F.when(hot, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in given.items()})

    @cached_property
    def inbound_command(self) -> DataFrame:
        """Found-stock adjustments only: none can be rejected."""
        return self._movements(F.lit("ADJUST"), F.col("quantity")).withColumns(
            {
                "location_id": F.coalesce("location_id", F.lit(0)),
                "employee_id": F.lit(1).cast("bigint"),
            }
        )


class UncleanTables(DerivedTables):
    """The same tables with faults of every kind, as input for the integrity jobs.

    Inactive products are gone though rows still refer to them, sales lines keep the
    source's repeating line numbers, and inventory is a raw load of movement rows.
    """

    @cached_property
    def product(self) -> DataFrame:
        return super().product.where(F.col("is_active") == "Y")

    @cached_property
    def so_line(self) -> DataFrame:
        price = F.lit(1).cast("decimal(12,2)")
        quantity = _quantity(F.col("l_quantity"))
        return self._typed(
            "so_line",
            self.raw("lineitem").select(
                (F.col("l_orderkey") * LINES_PER_HEADER + F.col("l_linenumber")).alias("so_line_id"),
                F.col("l_orderkey").alias("so_id"),
                F.col("l_linenumber").alias("line_number"),
                F.col("l_partkey").alias("product_id"),
                quantity.alias("qty_ordered"),
                quantity.alias("qty_shipped"),
                price.alias("unit_price"),
                (quantity * price).alias("line_total"),
            ),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        return self._typed(
            "inventory",
            self.movement_command.select(
                F.col("seq").alias("inventory_id"),
                "product_id", "warehouse_id", "location_id",
                F.col("qty").alias("qty_on_hand"),
                F.lit(0).alias("qty_reserved"),
                F.lit(_START).alias("updated_at"),
            ),
        )


# Values that break a row rule: table -> ((column, SQL value), ...)
_BREAKING: dict[str, tuple[tuple[str, str], ...]] = {
    "employee": (("is_active", "'X'"),),
    "product": (("is_active", "'X'"), ("unit_cost", "-1"), ("unit_price", "-1"), ("reorder_level", "-1")),
    "supplier": (("is_active", "'X'"),),
    "customer": (("is_active", "'X'"),),
    "warehouse": (("is_active", "'X'"),),
    "warehouse_location": (("zone_type", "'ROOF'"), ("is_active", "'X'")),
    "inventory": (("qty_on_hand", "-1"), ("qty_reserved", "-1")),
    "purchase_order": (("status", "'LOST'"),),
    "po_line": (("line_number", "0"), ("qty_ordered", "0"), ("qty_received", "-1"), ("unit_cost", "-1")),
    "goods_receipt": (("reason_code", "'LOST'"),),
    "goods_receipt_line": (("qty_received", "0"),),
    "sales_order": (("status", "'LOST'"),),
    "so_line": (("line_number", "0"), ("qty_ordered", "0"), ("qty_shipped", "-1"), ("unit_price", "-1")),
    "shipment": (("status", "'LOST'"), ("reason_code", "'LOST'")),
    "shipment_line": (("qty_shipped", "0"),),
    "stock_transfer": (("status", "'LOST'"), ("to_warehouse_id", "from_warehouse_id")),
    "stock_transfer_line": (
        ("to_location_id", "from_location_id"), ("qty_requested", "0"), ("qty_shipped", "-1"), ("qty_received", "-1"),
    ),
    "stock_transaction": (("transaction_type", "'LOST'"),),
}
#: One row in so many is repeated for a fault.
FAULT_EVERY = 5


class FaultyTables(DerivedTables):
    """A load in which rows are repeated with one fault each, so that every integrity rule is broken somewhere.

    Every row of every table comes once as it is. Where its key and the length of a column's name add up to a multiple
    of ``FAULT_EVERY``, it comes again for each fault that column can have: nothing in a required column, a reference to no
    row, a value that breaks a row rule. The units have no numbers, so each of them comes with every fault.
    """

    def __getitem__(self, name: str) -> DataFrame:
        rows = super().__getitem__(name)
        refers = dict(schemas.FOREIGN_KEYS.get(name, ()))
        faults = [(c, F.lit(None)) for c in schemas.required_columns(name)]
        faults += [(c, F.lit("NONE" if parent == "uom_lookup" else -1)) for c, parent in refers.items()]
        faults += [(c, F.expr(v)) for c, v in _BREAKING.get(name, ())]
        key = F.col(schemas.PRIMARY_KEY[name])

        def due(column: str) -> Column:
            return F.lit(True) if name == "uom_lookup" else (key + len(column)) % FAULT_EVERY == 0

        numbers = [F.when(due(column), F.lit(i)) for i, (column, _) in enumerate(faults)]
        rows = rows.withColumn("fault", F.explode(F.array_compact(F.array(F.lit(-1), *numbers))))
        shown = []
        for field in schemas.table_schema(name).fields:
            value = F.col(field.name)
            for i, (column, fault) in enumerate(faults):
                if column == field.name:
                    value = F.when(F.col("fault") == i, fault.cast(field.dataType)).otherwise(value)
            shown.append(value.alias(field.name))
        return rows.select(*shown)
