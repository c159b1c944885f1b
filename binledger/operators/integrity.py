"""Jobs that find the rows breaking a key, reference, domain or ledger rule.

All of them return ``rule_id, table_name, row_key`` and, where it helps, the
offending value. Every aggregation is on the tested key with map-side combine,
so a value that fills a third of a table costs no more than any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binledger import schemas
from binledger.functions.scan import CHUNK_ROWS, previous_value
from binledger.session import cut
from binledger.sources.tables import Tables


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _chosen(tables: Sequence[str] | None, known) -> list[str]:
    return [n for n in (tables or known) if n in known]


def _repeated(t: Tables, table: str, keys: Sequence[str], rule: str, nulls: bool) -> DataFrame:
    rows = t[table]
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    broken = (F.col("n_rows") > 1) & ~missing
    return counted.where(broken | missing if nulls else broken).select(
        F.lit(rule).alias("rule_id"),
        F.lit(table).alias("table_name"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("row_key"),
        "n_rows",
    )


def primary_key_violations(t: Tables, tables: Sequence[str] | None = None) -> DataFrame:
    """Primary key values that repeat or are NULL, with their number of rows.

    Tables are tested one after the other and what breaks the rule is written to the shared folder (this runs at once), so
    that the keys of one table only are shuffled at a time.
    """
    return _stack(
        [
            cut(_repeated(t, n, [schemas.PRIMARY_KEY[n]], f"PK {n}", nulls=True), "repeated")
            for n in _chosen(tables, schemas.PRIMARY_KEY)
        ]
    )


def unique_key_violations(t: Tables, tables: Sequence[str] | None = None) -> DataFrame:
    """Natural key values that repeat; a key with a NULL part repeats nothing."""
    return _stack(
        [
            _repeated(t, n, schemas.UNIQUE_KEY[n], f"UQ {n}", nulls=False)
            for n in _chosen(tables, schemas.UNIQUE_KEY)
        ]
    )


def _value(table: str, column: str, parent: str, rules: int) -> Column:
    """A value that refers to a row of ``parent`` or is its key, whole numbers as such; ``rules`` has the bits it stands for."""
    whole = isinstance(schemas.table_schema(table)[column].dataType, (T.LongType, T.IntegerType))
    value, none = F.col(column), F.lit(None)
    return F.struct(
        F.lit(parent).alias("parent"),
        (value if whole else none).cast("bigint").alias("number"),
        (none if whole else value).cast("string").alias("text"),
        F.lit(rules).cast("bigint").alias("rules"),
    )


def foreign_key_violations(t: Tables, tables: Sequence[str] | None = None) -> DataFrame:
    """Rows that refer to a parent row that is not there.

    Every rule has a bit, and bit 0 stands for "the parent has it". One read of each table gives its keys and references,
    and one aggregation ORs their bits by parent and value; what lacks bit 0 dangles and is kept as a table in the
    shared folder (this runs at once). Only tables with a rule that something breaks are read a second time.
    """
    chosen = _chosen(tables, schemas.FOREIGN_KEYS)
    rules = [(n, c, p) for n in chosen for c, p in schemas.FOREIGN_KEYS[n]]
    bit = {(n, c): 2 << i for i, (n, c, _) in enumerate(rules)}  # 41 rules fit a bigint
    parents = {p for _, _, p in rules}
    known = F.col("number").isNotNull() | F.col("text").isNotNull()

    values = []
    for name in sorted(parents.union(chosen)):
        made = [_value(n, c, p, bit[n, c]) for n, c, p in rules if n == name]
        if name in parents:
            made.append(_value(name, schemas.PRIMARY_KEY[name], name, 1))
        values.append(t[name].select(F.explode(F.array(*made)).alias("made")).select("made.*").where(known))
    met = _stack(values).groupBy("parent", "number", "text").agg(F.bit_or("rules").alias("broken"))
    dangling = cut(met.where(F.col("broken") % 2 == 0), "dangling")

    found = dangling.agg(F.bit_or("broken")).first()[0] or 0  # one number
    rows = []
    for name in chosen:
        made = [
            F.struct(F.lit(f"FK {n}.{c}").alias("rule_id"), _value(n, c, p, bit[n, c]).alias("made"))
            for n, c, p in rules if n == name and found & bit[n, c]
        ]
        if made:
            key = F.col(schemas.PRIMARY_KEY[name]).cast("string").alias("row_key")
            read = t[name].select(key, F.explode(F.array(*made)).alias("ref")).select("row_key", "ref.rule_id", "ref.made.*")
            rows.append(read.where(known).withColumn("table_name", F.lit(name)))
    if not rows:
        return dangling.where("false").select(*[F.lit("").alias(c) for c in ("rule_id", "table_name", "row_key", "value")])
    row, gone = _stack(rows).alias("row"), dangling.alias("gone")
    same = [F.col(f"row.{c}").eqNullSafe(F.col(f"gone.{c}")) for c in ("parent", "number", "text")]
    hit = F.col("row.rules").bitwiseAND(F.col("gone.broken")) != 0
    value = F.coalesce(F.col("number").cast("string"), F.col("text")).alias("value")
    return row.join(gone, reduce(lambda a, b: a & b, same, hit), "left_semi").select("rule_id", "table_name", "row_key", value)


def _flagged(t: Tables, table: str, flags: Sequence) -> DataFrame:
    """Rows of a table exploded by the rules they break, in one pass."""
    key = F.col(schemas.PRIMARY_KEY[table]).cast("string").alias("row_key")
    broken = t[table].select(key, F.array_compact(F.array(*flags)).alias("broken"))
    return broken.where(F.size("broken") > 0).select(
        F.explode("broken").alias("rule_id"), F.lit(table).alias("table_name"), "row_key"
    )


def check_violations(
    t: Tables, profile: str = "database", tables: Sequence[str] | None = None
) -> DataFrame:
    """Rows for which a row rule of the profile is false; NULL breaks no rule."""
    flags: dict[str, list] = defaultdict(list)
    for rule in schemas.check_rules(profile):
        flags[rule.table].append(F.when(~rule.holds, F.lit(rule.rule_id)))
    return _stack([_flagged(t, n, flags[n]) for n in _chosen(tables, flags)])


def not_null_violations(t: Tables, tables: Sequence[str] | None = None) -> DataFrame:
    """Rows with NULL in a required column."""
    parts = []
    for name in _chosen(tables, schemas.TABLE_DDL):
        flags = [
            F.when(F.col(c).isNull(), F.lit(f"NN {name}.{c}"))
            for c in schemas.required_columns(name)
        ]
        parts.append(_flagged(t, name, flags))
    return _stack(parts)


# --- fixed values: rows that keep a header from being deleted -----------------
# header -> (table referring to it, its column)
_HOLDS_HEADER = {
    "purchase_order": ("goods_receipt", "po_id"),
    "sales_order": ("shipment", "so_id"),
}
# header -> (table referring to its lines, its column)
_HOLDS_LINE = {
    "purchase_order": ("goods_receipt_line", "po_line_id"),
    "sales_order": ("shipment_line", "so_line_id"),
}


def cascade_delete(t: Tables, header: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete headers with their lines, unless something else refers to either.

    ``ids`` has the header key as its only column. Returns ``refused`` ids,
    ``deleted`` ids, ``deleted_lines``, and the ``headers`` and ``lines`` that stay.
    """
    line, key = schemas.CASCADES[header]
    line_key = schemas.PRIMARY_KEY[line]
    asked = ids.select(key).distinct().join(t[header].select(key), key, "left_semi")
    holding = []
    if header in _HOLDS_HEADER:
        table, column = _HOLDS_HEADER[header]
        holding.append(t[table].select(F.col(column).alias(key)))
    if header in _HOLDS_LINE:
        table, column = _HOLDS_LINE[header]
        used = t[table].select(F.col(column).alias(line_key))
        asked_lines = t[line].select(line_key, key).join(asked, key, "left_semi")
        holding.append(asked_lines.join(used, line_key, "left_semi").select(key))
    held = _stack(holding) if holding else asked.where(F.lit(False))
    deleted = asked.join(held, key, "left_anti")
    return {
        "refused": asked.join(held, key, "left_semi"),
        "deleted": deleted,
        "deleted_lines": t[line].join(deleted, key, "left_semi"),
        "headers": t[header].join(deleted, key, "left_anti"),
        "lines": t[line].join(deleted, key, "left_anti"),
    }


_SLOT = ("product_id", "warehouse_id", "location_id")


def ledger_chain_check(log: DataFrame, span: int = CHUNK_ROWS, carried: DataFrame | None = None) -> DataFrame:
    """Log rows that do not add up, or do not start where their slot's last row ended.

    With ``carried``, the last balances of a log checked before (``ledger_balances``), ``log`` is what came after it
    and nothing older is read.
    """
    rows = log.select("transaction_id", *_SLOT, "qty_change", "qty_before", "qty_after").withColumn("__old", F.lit(False))
    if carried is not None:
        ends = carried.select(
            "transaction_id", *_SLOT, F.lit(None).alias("qty_change"), F.lit(None).alias("qty_before"), "qty_after"
        )
        rows = rows.unionAll(ends.withColumn("__old", F.lit(True)))
    chained = previous_value(rows, [*_SLOT], "transaction_id", "qty_after", "previous_after", span)
    fault = F.when(
        F.col("qty_before") + F.col("qty_change") != F.col("qty_after"), "ARITHMETIC"
    ).when(F.col("previous_after") != F.col("qty_before"), "CHAIN")
    return chained.where(~F.col("__old")).drop("__old").withColumn("fault", fault).where(F.col("fault").isNotNull())


def ledger_balances(log: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Each slot's last log row and balance: of ``carried`` balances and the log rows that came after them."""
    rows = log.select(*_SLOT, "transaction_id", "qty_after")
    if carried is not None:
        rows = rows.unionByName(carried)
    last = rows.groupBy(*_SLOT).agg(F.max(F.struct("transaction_id", "qty_after")).alias("last"))
    return last.select(*_SLOT, "last.transaction_id", "last.qty_after")
