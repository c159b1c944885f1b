"""Reading, ingesting and writing the stock tables as parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binledger import schemas
from binledger.sources import seed

Tables = Mapping[str, DataFrame]


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One DataFrame per table over ``folder/<table>``, with its fixed schema."""

    def load(name: str) -> DataFrame:
        schema = schemas.table_schema(name)
        return spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.fieldNames())

    return {name: load(name) for name in schemas.TABLE_DDL}


def laid_out_log(log: DataFrame) -> DataFrame:
    """The log with ``transaction_month``, dealt and sorted by type, month and warehouse.

    Tasks hold neighbouring ranges, so there are hardly more files than tasks and folders together.
    """
    split = ["transaction_type", "transaction_month", "warehouse_id"]
    log = log.withColumn("transaction_month", F.date_format("transaction_date", "yyyy-MM"))
    return log.repartitionByRange(*split, "transaction_date").sortWithinPartitions(*split, "transaction_date")


def write_tables(tables: Tables, folder: str) -> None:
    """Write each table as a new parquet snapshot.

    The log is split by type and month and sorted by warehouse, so that look-ups by type read their
    folders only and those by warehouse and date skip row groups.
    """
    for name in schemas.TABLE_DDL:
        table = tables[name]
        if name == "stock_transaction":
            split = ["transaction_type", "transaction_month"]
            laid_out_log(table).write.mode("overwrite").partitionBy(*split).parquet(f"{folder}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")


def reseed(spark: SparkSession, folder: str) -> None:
    """Replace every table in ``folder`` by the sample rows."""
    write_tables(seed.seed_tables(spark), folder)


def register_views(spark: SparkSession, tables: Tables, as_of: str | None = None) -> None:
    """Name every table and reporting view for use in ``spark.sql``."""
    from binledger.operators import views

    for name in schemas.TABLE_DDL:
        tables[name].createOrReplaceTempView(name)
    for name, build in views.VIEWS.items():
        build(tables).createOrReplaceTempView(name)
    views.overdue_purchase_orders(tables, as_of).createOrReplaceTempView(
        "v_overdue_purchase_orders"
    )


def with_line_total(lines: DataFrame, unit: str) -> DataFrame:
    """The computed line amount: ordered quantity times ``unit``, to the cent."""
    return lines.withColumn(
        "line_total", (F.col("qty_ordered") * F.col(unit)).cast("decimal(14,2)")
    )


def _default(name: str, column: str, now: Column) -> Column | None:
    value = schemas.DEFAULTS.get(name, {}).get(column)
    if value is None:
        return None
    return {"now": now, "today": F.to_date(now)}.get(value, F.lit(value))


def ingest(name: str, raw: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Bring raw rows into a table's shape: ``(accepted, rejected)``.

    Missing or NULL values take the column default. A row is rejected when a
    required column is still NULL or a value does not fit its type; the rejected
    rows keep their raw columns and list the columns at fault.
    """
    stamp = F.current_timestamp() if now is None else now
    fields = schemas.table_schema(name).fields
    present = set(raw.columns)
    computed = {"line_total"} - present
    typed, faults = [], []
    for field in fields:
        if field.name in computed:
            continue
        kind = field.dataType.simpleString()
        given = F.col(field.name) if field.name in present else F.lit(None).cast("string")
        cast = given.try_cast(kind)
        default = _default(name, field.name, stamp)
        value = cast if default is None else F.coalesce(cast, default.cast(kind))
        bad = given.isNotNull() & cast.isNull()
        if not field.nullable:
            bad = bad | value.isNull()
        faults.append(F.when(bad, F.lit(field.name)))
        typed.append(value.alias(f"__{field.name}"))
    checked = raw.select("*", *typed, F.array_compact(F.array(*faults)).alias("faults"))
    good = checked.where(F.size("faults") == 0).select(
        *[F.col(f"__{f.name}").alias(f.name) for f in fields if f.name not in computed]
    )
    if "line_total" in computed and name in ("po_line", "so_line"):
        good = with_line_total(good, "unit_cost" if name == "po_line" else "unit_price")
    rejected = checked.where(F.size("faults") > 0).select(*raw.columns, "faults")
    return good.select(*[f.name for f in fields]), rejected
