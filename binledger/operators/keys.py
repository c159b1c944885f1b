"""Keys, defaults and totals worked out while loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger import schemas
from binledger.functions.scan import CHUNK_ROWS, id_levels, number_rows
from binledger.sources.tables import Tables


def highest(df: DataFrame, column: str) -> Column:
    """The largest value of a column as a scalar subquery, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint")).scalar()


def assign_surrogate_keys(
    rows: DataFrame, key: str, order: str, floor: Column | None = None, span: int = CHUNK_ROWS
) -> DataFrame:
    """Fill missing ids above every id in use, in ``order``; given ids stay.

    ``order`` is a bigint load position; rows without one come last. ``floor`` is the largest id already stored.
    """
    top = highest(rows, key)
    start = top if floor is None else F.greatest(top, floor)
    given = rows.where(F.col(key).isNotNull())
    missing = number_rows(
        rows.where(F.col(key).isNull()), id_levels(F.col(order), span), [order], "__n"
    )
    filled = missing.withColumn(key, F.col("__n") + start).select(*rows.columns)
    return given.unionByName(filled)


def upsert(
    base: DataFrame, changes: DataFrame, key: str, now: Column, order: str | None = None, deleted: str | None = None
) -> DataFrame:
    """Merge changes into rows by key; rows that differ get ``updated_at = now``.

    ``changes`` holds the key and the columns to set. Other columns keep their value. Of several changes of one key
    the one with the highest ``order`` counts, of equal ones the greatest by its values; without ``order`` a repeated key is an
    error, as is a NULL key, and no row is ever multiplied. A change marked in the boolean column ``deleted`` takes the row away, or adds none.
    The changes are reduced by the key they are joined on, so that costs no shuffle of its own.
    """
    values = [c for c in changes.columns if c not in (key, order, deleted)]
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    ranked = F.struct(*([F.col(order).alias("__order")] if order else []), gone.alias("__gone"), *[F.col(c).alias(f"__{c}") for c in values])
    newest = changes.groupBy(key).agg(F.max(ranked).alias("__row"), F.count(F.lit(1)).alias("__n"))
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a change without {key}")).cast("bigint"))
    if order is None:
        text = F.concat(F.lit(f"several changes of {key} "), F.col(key).cast("string"), F.lit(" and no order"))
        checked = checked.when(F.col("__n") > 1, F.raise_error(text).cast("bigint"))
    renamed = newest.select(
        F.coalesce(checked, F.col(key)).alias("__key"), "__row.__gone", *[F.col(f"__row.__{c}").alias(f"__{c}") for c in values]
    ).withColumn("__given", F.lit(True))
    joined = base.join(renamed, base[key] == renamed["__key"], "full").where(~F.coalesce("__gone", F.lit(False)))
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    changed = F.coalesce("__given", F.lit(False)) & (differs | F.col(key).isNull())
    result = []
    for c in base.columns:
        if c == key:
            value = F.coalesce(F.col(key), F.col("__key"))
        elif c == "updated_at":
            value = F.when(changed, now).otherwise(F.col(c))
        elif c in values:
            value = F.when(F.col("__given"), F.col(f"__{c}")).otherwise(F.col(c))
        else:
            value = F.col(c)
        result.append(value.alias(c))
    return joined.select(*result)


# --- fixed values: code column -> (table, id column) ---------------------------
_CODES = {
    "sku": ("product", "product_id"),
    "warehouse_code": ("warehouse", "warehouse_id"),
    "department_code": ("department", "department_id"),
    "category_code": ("product_category", "category_id"),
    "employee_code": ("employee", "employee_id"),
    "supplier_code": ("supplier", "supplier_id"),
    "customer_code": ("customer", "customer_id"),
    "po_number": ("purchase_order", "po_id"),
    "so_number": ("sales_order", "so_id"),
    "transfer_number": ("stock_transfer", "transfer_id"),
}


def resolve_natural_keys(t: Tables, rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Replace code columns by ids; a row with an unknown code is dropped.

    A ``location_code`` is only unique within a warehouse, so it is resolved with
    ``warehouse_code``, which has to be given too.
    """
    if "location_code" in codes and "warehouse_code" not in codes:
        raise ValueError("location_code needs warehouse_code")
    for code in [c for c in codes if c != "location_code"]:
        table, key = _CODES[code]
        rows = rows.join(t[table].select(key, code), code).drop(code)
    if "location_code" in codes:
        bins = t["warehouse_location"].select("warehouse_id", "location_code", "location_id")
        rows = rows.join(bins, ["warehouse_id", "location_code"]).drop("location_code")
    return rows


def header_totals(t: Tables, header: str) -> DataFrame:
    """Order headers with ``total_amount`` summed from their lines, 0 without lines."""
    line, key = schemas.CASCADES[header]
    totals = t[line].groupBy(key).agg(
        F.sum("line_total").cast("decimal(14,2)").alias("__total")
    )
    columns = t[header].columns
    return (
        t[header]
        .join(totals, key, "left")
        .withColumn(
            "total_amount", F.coalesce("__total", F.lit(0)).cast("decimal(14,2)")
        )
        .select(*columns)
    )
