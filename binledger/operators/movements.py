"""Replaying a batch of stock movements, each accepted or rejected in its turn.

A movement touches slots and order lines of one product only, so products are
independent of each other. Within a product the order of ``seq`` decides: a
rejected movement leaves no trace for the later ones. ``deciding`` folds products in parallel and
cuts those with very many movements in time.

``seq`` has to be given and unique: movements without one, and all that share one, are
rejected as MALFORMED.

The input snapshot has to satisfy the integrity rules (reserved within on-hand,
order lines with existing products). A given ``header_id`` has to exist in the
snapshot: a batch cannot append to a document it opens itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger import schemas
from binledger.functions.fold import CODE, FIELDS, KINDS, REASONS
from binledger.functions.scan import (
    CHUNK_ROWS,
    id_levels,
    number_rows,
    running_sums,
)
from binledger.operators import deciding
from binledger.operators.deciding import kind_is
from binledger.operators.keys import highest
from binledger.session import cut, put, remove, remove_cut
from binledger.sources.snapshots import DECISIONS, Snapshots, touched_buckets
from binledger.sources.tables import Tables, write_tables


def _milli(column: str) -> Column:
    return (F.col(column) * 1000).cast("bigint")


def quantity(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return (value.cast("decimal(18,0)") / F.lit(1000)).cast("decimal(12,3)")


def _first_code(*cases: tuple[Column, str]) -> Column:
    """Code of the first case that is true, 0 if none is; NULL counts as false."""
    result = F.lit(0)
    for condition, reason in reversed(cases):
        result = F.when(condition, F.lit(CODE[reason])).otherwise(result)
    return result.cast("bigint")


def order_lines(t: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Purchase and sales lines with what a movement needs of their header.

    ``wanted(cmd, line_id)``, if given, names the lines; only they meet their headers.
    """

    def lines_of(kind: str, line: str) -> DataFrame:
        if wanted is None:
            return t[line]
        ids = wanted.where(F.col("cmd") == kind).select(F.col("line_id").alias(schemas.PRIMARY_KEY[line])).distinct()
        return t[line].join(ids, schemas.PRIMARY_KEY[line], "left_semi")

    def side(kind: str, line: str, header: str, key: str, number: str, done: str) -> DataFrame:
        headers = t[header].select(
            key, F.col("warehouse_id").alias("line_wh"), F.col(number).alias("order_number")
        )
        return (
            lines_of(kind, line)
            .join(headers, key)
            .select(
                F.lit(kind).alias("cmd"),
                F.col(schemas.PRIMARY_KEY[line]).alias("line_key"),
                F.col("product_id").alias("line_product"),
                "line_wh",
                F.col(key).alias("order_id"),
                "order_number",
                _milli("qty_ordered").alias("line_ordered"),
                _milli(done).alias("line_done"),
            )
        )

    return side("RECEIVE", "po_line", "purchase_order", "po_id", "po_number", "qty_received").unionAll(
        side("SHIP", "so_line", "sales_order", "so_id", "so_number", "qty_shipped")
    )


def _with_flag(df: DataFrame, keys: dict[str, str], parent: DataFrame, flag: str) -> DataFrame:
    """Left join that tells whether ``parent`` has the row; ``keys`` maps df to parent."""
    marked = parent.select(
        *[F.col(p).alias(f"__p_{p}") for p in keys.values()], F.lit(True).alias(flag)
    )
    # NULL would send all of them to one task; spread keys may match anything, but nobody asks for the flag of a NULL.
    spread = {c: F.coalesce(c, -F.col("seq") - 1) if c != "cmd" else F.col(c) for c in keys}
    df = df.withColumns({f"__k_{c}": value for c, value in spread.items()})
    same = reduce(
        lambda a, b: a & b, (F.col(f"__k_{c}") == F.col(f"__p_{p}") for c, p in keys.items())
    )
    joined = df.join(marked, same, "left").drop(*[f"__p_{p}" for p in keys.values()], *[f"__k_{c}" for c in keys])
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def _with_document_flag(c: DataFrame, commands: DataFrame, t: Tables) -> DataFrame:
    """Tell whether a given receipt or shipment exists.

    Commands usually open a document of their own. A look at the pushed-down filter
    saves a batch without given documents the join; a stream cannot look ahead.
    """
    if not commands.isStreaming and commands.where(F.col("header_id").isNotNull()).isEmpty():
        return c.withColumn("header_ok", F.lit(True))
    documents = (
        t["goods_receipt"]
        .select(F.lit("RECEIVE").alias("cmd"), F.col("receipt_id").alias("header_id"))
        .unionAll(
            t["shipment"].select(F.lit("SHIP").alias("cmd"), F.col("shipment_id").alias("header_id"))
        )
    )
    return _with_flag(c, {"cmd": "cmd", "header_id": "header_id"}, documents, "header_ok")


def _with_lines(commands: DataFrame, t: Tables) -> DataFrame:
    """Commands with their order line, and the product and warehouse it names."""
    kinds = F.create_map(*[x for i, k in enumerate(KINDS[1:5], 1) for x in (F.lit(k), F.lit(i))])
    on_line = F.col("cmd").isin("RECEIVE", "SHIP")
    named = F.coalesce(on_line & F.col("line_id").isNotNull(), F.lit(False))
    c = commands.withColumns(
        {
            "kind": F.coalesce(F.try_element_at(kinds, F.col("cmd")), F.lit(-1)),
            "employee_id": F.coalesce("employee_id", F.lit(1)),
            "line_key": F.when(named, F.col("line_id")).otherwise(-F.col("seq")),
        }
    )
    wanted = None if commands.isStreaming else commands.where(named)
    lines = order_lines(t, wanted)
    met = c.where(named).join(lines, ["cmd", "line_key"], "left")
    fields = {f.name: f.dataType for f in lines.schema if f.name not in c.columns}
    # Commands that name no line don't have to meet any.
    rest = c.where(~named).withColumns({n: F.lit(None).cast(kind) for n, kind in fields.items()})
    return met.unionByName(rest).withColumns(
        {
            "product_id": F.when(on_line, F.col("line_product")).otherwise(F.col("product_id")),
            "warehouse_id": F.when(on_line, F.col("line_wh")).otherwise(F.col("warehouse_id")),
        }
    )


def prepare(commands: DataFrame, t: Tables, faulty: Column | None = None) -> DataFrame:
    """Commands with their order line, slots and all checks that no stock level affects.

    Works on a stream of commands too. ``early``, ``middle`` and ``late`` are the
    codes of static faults by when they count: before the check of the open
    quantity, between it and the stock checks, and after them. ``faulty`` marks commands
    that are malformed for reasons of their own.
    """
    c = _with_lines(commands, t)
    c = _with_flag(c, {"employee_id": "employee_id"}, t["employee"], "employee_ok")
    c = _with_flag(c, {"warehouse_id": "warehouse_id"}, t["warehouse"], "wh_ok")
    c = _with_flag(c, {"to_warehouse_id": "warehouse_id"}, t["warehouse"], "to_wh_ok")
    c = _with_flag(c, {"location_id": "location_id"}, t["warehouse_location"], "bin_ok")
    c = _with_flag(c, {"to_location_id": "location_id"}, t["warehouse_location"], "to_bin_ok")
    c = _with_flag(c, {"product_id": "product_id"}, t["product"], "product_ok")
    c = _with_document_flag(c, commands, t)
    return _checked(c, F.lit(False) if faulty is None else faulty)


# Flags of a command: column that refers -> (flag, table, its key)
_FLAGS = {
    "employee_id": ("employee_ok", "employee", "employee_id"),
    "warehouse_id": ("wh_ok", "warehouse", "warehouse_id"),
    "to_warehouse_id": ("to_wh_ok", "warehouse", "warehouse_id"),
    "location_id": ("bin_ok", "warehouse_location", "location_id"),
    "to_location_id": ("to_bin_ok", "warehouse_location", "location_id"),
    "product_id": ("product_ok", "product", "product_id"),
}
_DOCUMENTS = {"RECEIVE": ("goods_receipt", "receipt_id"), "SHIP": ("shipment", "shipment_id")}


def _odd_references(commands: DataFrame, lined: DataFrame, t: Tables) -> DataFrame:
    """``(parent, id, n)``: what commands refer to and ``n`` rows of the parent have, if that is not one.

    ``seq`` stands among the parents with the numbers that repeat. References are mostly sound, so this is a small table.
    """
    asked, there = F.lit(1).alias("asked"), F.lit(1).alias("n")

    def refers(parent: str, rows: DataFrame, *columns: str) -> DataFrame:
        whole = [F.col(c).cast("bigint") for c in columns]
        ids = F.explode(F.array(*whole)) if len(columns) > 1 else whole[0]
        return rows.select(ids.alias("id")).distinct().select(F.lit(parent).alias("parent"), "id", asked, F.lit(0).alias("n"))

    def has(parent: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.lit(parent).alias("parent"), F.col(key).cast("bigint").alias("id"), F.lit(0).alias("asked"), there)

    parts = [commands.select(F.lit("seq").alias("parent"), F.col("seq").cast("bigint").alias("id"), asked, there)]
    for table, key in dict.fromkeys((table, key) for _, table, key in _FLAGS.values()):
        columns = [c for c, (_, parent, _) in _FLAGS.items() if parent == table]
        parts += [refers(table, lined, *columns), has(table, t[table], key)]
    given = commands.where(F.col("header_id").isNotNull())
    if not given.isEmpty():
        for cmd, (table, key) in _DOCUMENTS.items():
            parts += [refers(table, given.where(F.col("cmd") == cmd), "header_id"), has(table, t[table], key)]
    counted = reduce(DataFrame.unionAll, parts).where(F.col("id").isNotNull()).groupBy("parent", "id")
    return counted.agg(F.max("asked").alias("asked"), F.sum("n").alias("n")).where("asked = 1 AND n <> 1").drop("asked")


def _with_odd(lined: DataFrame, odd: DataFrame) -> DataFrame:
    """The flags of ``prepare`` from the odd references, and ``repeated``; a command comes once for each row of its parents."""
    c, copies = lined, F.lit(1).cast("bigint")
    documents = F.create_map(*[F.lit(x) for cmd, (table, _) in _DOCUMENTS.items() for x in (cmd, table)])
    looked = {column: (F.lit(table), flag) for column, (flag, table, _) in _FLAGS.items()}
    looked |= {"header_id": (F.try_element_at(documents, F.col("cmd")), "header_ok"), "seq": (F.lit("seq"), "repeated")}
    for column, (parent, flag) in looked.items():
        found = odd.select(F.col("parent").alias("__parent"), F.col("id").alias("__id"), F.col("n").alias("__n"))
        c = c.join(found, (F.col(column) == F.col("__id")) & (F.col("__parent") == parent), "left")
        n = F.coalesce("__n", F.lit(1))
        if flag == "repeated":
            c = c.withColumn(flag, n > 1)
        else:
            c = c.withColumn(flag, F.col(column).isNotNull() & (n > 0)).withColumn(f"__n_{flag}", F.greatest(F.lit(1), n))
            copies = copies * F.col(f"__n_{flag}")
        c = c.drop("__parent", "__id", "__n")
    if odd.where("n > 1 AND parent <> 'seq'").isEmpty():
        return c
    return c.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))


def _checked(c: DataFrame, faulty: Column) -> DataFrame:
    """Commands that have their lines and flags, in the shape of the fold, with the codes of their static faults."""
    on_line = F.col("cmd").isin("RECEIVE", "SHIP")
    header_ok = F.col("header_ok") | F.col("header_id").isNull()

    transfer, adjust = F.col("cmd") == "TRANSFER", F.col("cmd") == "ADJUST"
    slot_given = F.col("location_id").isNotNull() & F.col("qty").isNotNull()
    own_slot = F.col("product_id").isNotNull() & F.col("warehouse_id").isNotNull()
    complete = (
        F.when(on_line, slot_given & F.col("line_id").isNotNull())
        .when(adjust, slot_given & own_slot)
        .when(
            transfer,
            slot_given & own_slot & F.col("to_warehouse_id").isNotNull()
            & F.col("to_location_id").isNotNull(),
        )
        .otherwise(F.lit(False))
    )
    same_bin = F.col("location_id") == F.col("to_location_id")
    early = _first_code(
        (faulty | ~complete, "MALFORMED"),
        (transfer & same_bin & (F.col("warehouse_id") == F.col("to_warehouse_id")), "SAME_BIN"),
        ((on_line | transfer) & (F.col("qty") <= 0), "NONPOSITIVE_QTY"),
        (adjust & (F.col("qty") == 0), "ZERO_QTY"),
        (on_line & F.col("line_product").isNull(), "LINE_NOT_FOUND"),
        (
            transfer & ~(F.col("wh_ok") & F.col("to_wh_ok") & F.col("employee_ok")),
            "UNKNOWN_REFERENCE",
        ),
        (transfer & same_bin, "SAME_LOCATION_ID"),
        (
            transfer & ~(F.col("product_ok") & F.col("bin_ok") & F.col("to_bin_ok")),
            "UNKNOWN_REFERENCE",
        ),
    )
    references = F.col("employee_ok") & F.col("bin_ok") & F.col("product_ok") & header_ok
    number = {name: F.coalesce(name, F.lit(-1)).cast("bigint") for name in (
        "product_id", "warehouse_id", "location_id", "to_warehouse_id", "to_location_id", "line_key",
    )}
    zero = F.lit(0).cast("bigint")
    work = {
        "kind": F.col("kind").cast("bigint"),
        "milli": F.coalesce(_milli("qty"), zero),
        "early": early,
        "middle": _first_code((on_line & ~references, "UNKNOWN_REFERENCE")),
        "late": _first_code((adjust & ~F.col("employee_ok"), "UNKNOWN_REFERENCE")),
        "may_create": (F.col("wh_ok") & F.col("bin_ok") & F.col("product_ok")).cast("bigint"),
        "line": number["line_key"],
        "line_ordered": F.coalesce("line_ordered", zero),
        "line_done": F.coalesce("line_done", zero),
        "src_wh": number["warehouse_id"],
        "src_loc": number["location_id"],
        "dst_wh": number["to_warehouse_id"],
        "dst_loc": number["to_location_id"],
        **{n: zero for n in FIELDS[13:]},
    }
    carried = [
        "seq", "cmd", "line_id", "qty", "employee_id", "header_id", "reason_code", "carrier",
        "tracking_number", "notes", "order_id", "order_number",
    ]
    return c.select(
        *carried,
        # Faulty rows without a product are spread out; no state depends on them.
        F.coalesce("product_id", -F.col("seq") - 1, F.lit(-1)).cast("bigint").alias("product_id"),
        *[work[n].alias(n) for n in FIELDS],
    )


def _counted(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0)).cast("bigint")


def _legs(rows: DataFrame) -> DataFrame:
    """One row per slot a command touches; leg 0 is the one that can fail."""

    def leg(number: int, wh: str, loc: str, change: Column, shipped: Column) -> Column:
        return F.struct(
            F.lit(number).alias("leg"),
            F.col(wh).alias("wh"),
            F.col(loc).alias("loc"),
            change.cast("bigint").alias("change"),
            shipped.cast("bigint").alias("shipped"),
        )

    q = F.col("milli")
    signed = (
        F.when(kind_is("OPEN"), F.col("src_on_hand")).when(kind_is("SHIP", "TRANSFER"), -q).otherwise(q)
    )
    source = leg(0, "src_wh", "src_loc", signed, _counted(kind_is("SHIP"), q))
    target = leg(1, "dst_wh", "dst_loc", q, F.lit(0))
    pairs = F.when(kind_is("TRANSFER"), F.array(source, target)).otherwise(F.array(source))
    return rows.select("*", F.explode(pairs).alias("__leg")).select(*rows.columns, "__leg.*")


# -- the operator ------------------------------------------------------------------


def outcomes(commands: DataFrame, t: Tables, chunk_rows: int = deciding.CHUNK_ROWS) -> DataFrame:
    """Decide every command: ``code`` 0 or a reject reason, and the balances before it.

    Commands with their lines, references with no row or several, and every round of decisions are written to the
    shared folder; the result only reads what is written. ``chunk_rows`` is the least size of a stretch, see ``deciding``.
    """
    spark = commands.sparkSession
    path = put(commands, "movement-commands")
    commands = spark.read.schema(commands.schema).parquet(path)
    lined = cut(_with_lines(commands, t), "movement-lined")
    odd = cut(_odd_references(commands, lined, t), "movement-odd")
    remove(spark, path)
    faulty = F.col("seq").isNull() | F.col("repeated")
    decided = deciding.decide(_checked(_with_odd(lined, odd), faulty), t["inventory"], chunk_rows)
    remove_cut(lined)
    return decided


def reason_name() -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("code") + 1).cast("int"))


@dataclass
class Replay:
    """Everything a decided batch changes, each as a DataFrame.

    ``outcomes`` reads written tables: every part below reads it again. ``now`` stamps
    new and changed rows.
    """

    outcomes: DataFrame
    tables: Tables
    now: Column
    span: int = CHUNK_ROWS

    # -- accepted commands and their documents --

    def discard(self) -> None:
        """Remove the work tables in the shared folder. What was written elsewhere stays; nothing here can be read any more."""
        made = [self.outcomes, *(self.__dict__[n] for n in ("documents", "_slot_changes") if n in self.__dict__)]
        for table in made:
            remove_cut(table)

    def rejects(self) -> DataFrame:
        return self.outcomes.where(F.col("code") != 0).select(
            "seq", reason_name().alias("reason")
        )

    def accepted(self) -> DataFrame:
        return self.outcomes.where(F.col("code") == 0)

    def _numbered(self, df: DataFrame, order: list[str], name: str, within=()) -> DataFrame:
        return number_rows(df, id_levels(F.col("seq"), self.span), order, name, within)

    @cached_property
    def documents(self) -> DataFrame:
        """Accepted commands with the document they belong to, written out once.

        Receipts, shipments and transfers each count on from the highest id in use.
        """
        t = self.tables
        opens = kind_is("RECEIVE", "SHIP", "TRANSFER") & F.col("header_id").isNull()
        counted = self._numbered(
            self.accepted().withColumn("opens", opens), ["seq"], "nth", ["cmd", "opens"]
        )
        base = (
            F.when(kind_is("RECEIVE"), highest(t["goods_receipt"], "receipt_id"))
            .when(kind_is("SHIP"), highest(t["shipment"], "shipment_id"))
            .when(kind_is("TRANSFER"), highest(t["stock_transfer"], "transfer_id"))
        )
        named = cut(
            counted.withColumn(
                "document_id",
                F.when(F.col("opens"), base + F.col("nth")).otherwise(F.col("header_id")),
            ),
            "movement-counted",
        )
        moved = named.where(kind_is("TRANSFER"))
        rest = named.where(~kind_is("TRANSFER")).withColumn(
            "transfer_number", F.lit(None).cast("string")
        )
        return cut(
            moved.join(self._transfer_numbers(moved), "seq").unionByName(rest),
            "movement-documents",
        )

    def _transfer_numbers(self, transfers: DataFrame) -> DataFrame:
        """The number of each accepted transfer: the next one not in use yet.

        The k-th new transfer takes the k-th unused number above the highest id.
        A used number moves every later one up by one.
        """
        stored = self.tables["stock_transfer"]
        top = highest(stored, "transfer_id")
        text = F.regexp_extract("transfer_number", r"^XFR-2025-(\d{4,18})$", 1)
        used = (
            stored.where(text != "")
            .select("transfer_number", text.try_cast("bigint").alias("number"))
            .where(
                (F.col("number") > top)
                & (F.format_string("XFR-2025-%04d", "number") == F.col("transfer_number"))
            )
            .select("number")
            .distinct()
        )
        ranked = number_rows(used, id_levels(F.col("number"), self.span), ["number"], "j")
        steps = ranked.select(
            (F.col("number") - top - F.col("j") + 1).alias("at"),
            F.lit(0).alias("turn"),
            F.lit(1).cast("bigint").alias("step"),
            F.lit(None).cast("bigint").alias("seq"),
        )
        wanted = transfers.select(
            F.col("nth").alias("at"), F.lit(1).alias("turn"),
            F.lit(0).cast("bigint").alias("step"), "seq",
        )
        scanned = running_sums(
            steps.unionAll(wanted).withColumn("all", F.lit(1)),
            ["all"], ["at", "turn"], {"skipped": F.col("step")}, span=self.span,
        ).where(F.col("turn") == 1)
        return scanned.select(
            "seq",
            F.format_string("XFR-2025-%04d", top + F.col("at") + F.col("skipped")).alias(
                "transfer_number"
            ),
        )

    # -- ledger --

    def ledger(self) -> DataFrame:
        """New log rows, numbered on from the log, with ``seq`` and ``leg``."""
        q = F.col("milli")

        def leg(number, kind, wh, loc, change, before, note) -> Column:
            return F.struct(
                F.lit(number).alias("leg"),
                kind.alias("transaction_type"),
                F.col(wh).alias("warehouse_id"),
                F.col(loc).alias("location_id"),
                change.alias("change"),
                F.col(before).alias("before"),
                note.alias("notes"),
            )

        def transfer_note(way: str, wh: str) -> Column:
            return F.concat(
                F.lit("Transfer "), "transfer_number", F.lit(f" {way} WH-"), F.col(wh).cast("string")
            )

        single = leg(
            0,
            F.when(kind_is("RECEIVE"), "RECEIPT").when(kind_is("SHIP"), "ISSUE").otherwise("ADJUSTMENT"),
            "src_wh", "src_loc", F.when(kind_is("SHIP"), -q).otherwise(q), "src_before",
            F.when(kind_is("RECEIVE"), F.concat(F.lit("Receipt for PO "), "order_number"))
            .when(kind_is("SHIP"), F.concat(F.lit("Shipment for SO "), "order_number"))
            .otherwise(F.col("notes")),
        )
        out = leg(0, F.lit("TRANSFER_OUT"), "src_wh", "src_loc", -q, "src_before",
                  transfer_note("OUT to", "dst_wh"))
        into = leg(1, F.lit("TRANSFER_IN"), "dst_wh", "dst_loc", q, "dst_before",
                   transfer_note("IN from", "src_wh"))
        rows = (
            self.documents.select(
                "seq", "product_id", "kind", "document_id", "employee_id", "reason_code",
                F.explode(
                    F.when(kind_is("TRANSFER"), F.array(out, into)).otherwise(F.array(single))
                ).alias("entry"),
            )
            .select("*", "entry.*")
        )
        top = highest(self.tables["stock_transaction"], "transaction_id")
        numbered = self._numbered(rows, ["seq", "leg"], "position")
        return numbered.select(
            (top + F.col("position")).alias("transaction_id"),
            "product_id", "warehouse_id", "location_id", "transaction_type",
            quantity("change").alias("qty_change"),
            quantity("before").alias("qty_before"),
            quantity(F.col("before") + F.col("change")).alias("qty_after"),
            F.when(kind_is("RECEIVE"), "GOODS_RECEIPT")
            .when(kind_is("SHIP"), "SHIPMENT")
            .when(kind_is("TRANSFER"), "TRANSFER")
            .otherwise(F.coalesce("reason_code", F.lit("MANUAL_ADJUSTMENT")))
            .alias("reference_type"),
            F.col("document_id").alias("reference_id"),
            "employee_id",
            self.now.alias("transaction_date"),
            "notes", "seq", "leg",
        )

    # -- state --

    @cached_property
    def _slot_changes(self) -> DataFrame:
        return cut(
            _legs(self.accepted()).groupBy("product_id", "wh", "loc").agg(
                F.sum("change").alias("change"),
                F.sum("shipped").alias("shipped"),
                F.min("seq").alias("seq"),
            ),
            "movement-slots",
        )

    def slot_changes(self) -> DataFrame:
        """What the batch adds to each slot it touches, in thousandths, and its first command there; written out once."""
        return self._slot_changes

    def inventory(self) -> DataFrame:
        """The whole inventory after the batch; new slots in the order they came up."""
        changes = self.slot_changes().withColumnRenamed("product_id", "__product")
        old = self.tables["inventory"]
        same = (
            (old.product_id == F.col("__product"))
            & (old.warehouse_id == F.col("wh"))
            & (old.location_id == F.col("loc"))
        )
        touched = F.col("seq").isNotNull()
        zero = F.lit(0)
        new_hand = F.coalesce("qty_on_hand", zero) + F.coalesce(quantity("change"), zero)
        new_reserved = F.greatest(
            zero, F.coalesce("qty_reserved", zero) - F.coalesce(quantity("shipped"), zero)
        )

        def state(joined: DataFrame) -> DataFrame:
            return joined.select(
                "inventory_id",
                F.coalesce("product_id", "__product").alias("product_id"),
                F.coalesce("warehouse_id", "wh").alias("warehouse_id"),
                F.coalesce("location_id", "loc").alias("location_id"),
                new_hand.cast("decimal(12,3)").alias("qty_on_hand"),
                F.when(touched, new_reserved)
                .otherwise(F.col("qty_reserved"))
                .cast("decimal(12,3)")
                .alias("qty_reserved"),
                "last_count_date",
                F.when(touched, self.now).otherwise(F.col("updated_at")).alias("updated_at"),
                "seq",
            )

        held = state(old.join(changes, same, "left"))
        absent = {f.name: F.lit(None).cast(f.dataType) for f in old.schema}
        opened = state(changes.join(old, same, "left_anti").withColumns(absent))
        # Numbering reads its rows more than once: new slots are few beside the inventory.
        unnumbered = cut(held.where(F.col("inventory_id").isNull()).unionByName(opened), "movement-opened")
        fresh = self._numbered(unnumbered, ["seq"], "nth")
        top = highest(old, "inventory_id")
        return held.where(F.col("inventory_id").isNotNull()).drop("seq").unionByName(
            fresh.withColumn("inventory_id", top + F.col("nth")).drop("seq", "nth")
        )

    def _lines(self, cmd: str, table: str, done: str) -> DataFrame:
        key = schemas.PRIMARY_KEY[table]
        moved = (
            self.accepted()
            .where(F.col("cmd") == cmd)
            .groupBy(F.col("line_id").alias(key))
            .agg(F.sum("milli").alias("__moved"))
        )
        columns = schemas.table_schema(table).fieldNames()
        total = F.col(done) + F.coalesce(quantity("__moved"), F.lit(0))
        return (
            self.tables[table]
            .join(moved, key, "left")
            .withColumn(done, total.cast("decimal(12,3)"))
            .select(*columns)
        )

    def po_line(self) -> DataFrame:
        return self._lines("RECEIVE", "po_line", "qty_received")

    def so_line(self) -> DataFrame:
        return self._lines("SHIP", "so_line", "qty_shipped")

    def _headers(self, cmd: str, table: str, lines: DataFrame, done: str, full: str) -> DataFrame:
        key = schemas.PRIMARY_KEY[table]
        touched = (
            self.accepted().where(F.col("cmd") == cmd).select(F.col("order_id").alias(key)).distinct()
        )
        open_quantity = (
            lines.groupBy(key)
            .agg(F.sum(F.col("qty_ordered") - F.col(done)).alias("__open"))
            .join(touched, key, "left_semi")
        )
        promoted = F.when(F.col("__open") == 0, full).otherwise("PARTIAL")
        moved = F.col("__open").isNotNull()
        columns = schemas.table_schema(table).fieldNames()
        return (
            self.tables[table]
            .join(open_quantity, key, "left")
            .withColumns(
                {
                    "status": F.when(moved, promoted).otherwise(F.col("status")),
                    "updated_at": F.when(moved, self.now).otherwise(F.col("updated_at")),
                }
            )
            .select(*columns)
        )

    def purchase_order(self) -> DataFrame:
        """Orders after the batch; those received on become RECEIVED or PARTIAL."""
        return self._headers(
            "RECEIVE", "purchase_order", self.po_line(), "qty_received", "RECEIVED"
        )

    def sales_order(self) -> DataFrame:
        """Orders after the batch; those shipped from become SHIPPED or PARTIAL."""
        return self._headers("SHIP", "sales_order", self.so_line(), "qty_shipped", "SHIPPED")

    # -- new documents --

    def _opened(self, cmd: str) -> DataFrame:
        return self.documents.where((F.col("cmd") == cmd) & F.col("opens"))

    def _document_lines(self, cmd: str, table: str, columns: dict[str, Column]) -> DataFrame:
        key = schemas.PRIMARY_KEY[table]
        rows = self._numbered(
            self.documents.where(F.col("cmd") == cmd).drop("nth"), ["seq"], "nth"
        )
        top = highest(self.tables[table], key)
        return rows.select(
            (top + F.col("nth")).alias(key), *[c.alias(n) for n, c in columns.items()]
        )

    def goods_receipt(self) -> DataFrame:
        return self._opened("RECEIVE").select(
            F.col("document_id").alias("receipt_id"),
            F.format_string("GR-%010d", "document_id").alias("receipt_number"),
            F.col("order_id").alias("po_id"),
            F.to_date(self.now).alias("receipt_date"),
            F.col("employee_id").alias("received_by"),
            F.lit("STANDARD").alias("reason_code"),
            F.lit(None).cast("string").alias("notes"),
            self.now.alias("created_at"),
        )

    def goods_receipt_line(self) -> DataFrame:
        return self._document_lines(
            "RECEIVE", "goods_receipt_line",
            {
                "receipt_id": F.col("document_id"),
                "po_line_id": F.col("line_id"),
                "product_id": F.col("product_id"),
                "location_id": F.col("src_loc"),
                "qty_received": F.col("qty"),
            },
        )

    def shipment(self) -> DataFrame:
        given = F.when(F.col("tracking_number") != "", F.col("tracking_number"))
        return self._opened("SHIP").select(
            F.col("document_id").alias("shipment_id"),
            F.format_string("SH-%010d", "document_id").alias("shipment_number"),
            F.col("order_id").alias("so_id"),
            F.to_date(self.now).alias("ship_date"),
            F.coalesce("carrier", F.lit("FedEx")).alias("carrier"),
            F.coalesce(given, F.format_string("TRK-%06d-US", "document_id")).alias(
                "tracking_number"
            ),
            F.lit("PENDING").alias("status"),
            F.col("employee_id").alias("shipped_by"),
            F.lit("STANDARD").alias("reason_code"),
            self.now.alias("created_at"),
        )

    def shipment_line(self) -> DataFrame:
        return self._document_lines(
            "SHIP", "shipment_line",
            {
                "shipment_id": F.col("document_id"),
                "so_line_id": F.col("line_id"),
                "product_id": F.col("product_id"),
                "location_id": F.col("src_loc"),
                "qty_shipped": F.col("qty"),
            },
        )

    def stock_transfer(self) -> DataFrame:
        return (
            self.documents.where(kind_is("TRANSFER"))
            .select(
                F.col("document_id").alias("transfer_id"),
                "transfer_number",
                F.col("src_wh").alias("from_warehouse_id"),
                F.col("dst_wh").alias("to_warehouse_id"),
                F.to_date(self.now).alias("request_date"),
                F.lit(None).cast("date").alias("ship_date"),
                F.lit(None).cast("date").alias("receive_date"),
                F.lit("COMPLETED").alias("status"),
                F.col("employee_id").alias("requested_by"),
                F.coalesce(
                    F.when(F.col("notes") != "", F.col("notes")), F.lit("Direct transfer")
                ).alias("notes"),
                self.now.alias("created_at"),
                self.now.alias("updated_at"),
            )
        )

    def stock_transfer_line(self) -> DataFrame:
        return self._document_lines(
            "TRANSFER", "stock_transfer_line",
            {
                "transfer_id": F.col("document_id"),
                "product_id": F.col("product_id"),
                "from_location_id": F.col("src_loc"),
                "to_location_id": F.col("dst_loc"),
                "qty_requested": F.col("qty"),
                "qty_shipped": F.col("qty"),
                "qty_received": F.col("qty"),
            },
        )


def replay(
    commands: DataFrame,
    t: Tables,
    now: Column | None = None,
    **options,
) -> Replay:
    """Decide a batch, write the decisions to the shared folder, derive all changes."""
    stamp = F.current_timestamp() if now is None else now
    return Replay(outcomes(commands, t, **options), t, stamp)


_APPENDED = (
    "goods_receipt", "goods_receipt_line", "shipment", "shipment_line", "stock_transfer",
    "stock_transfer_line",
)
_REWRITTEN = ("inventory", "po_line", "so_line", "purchase_order", "sales_order")


def next_tables(result: Replay) -> dict[str, DataFrame]:
    """All tables as they stand after a replay: changed, added to, or as they were."""
    after = {name: result.tables[name] for name in schemas.TABLE_DDL}
    for name in _REWRITTEN:
        after[name] = getattr(result, name)()
    for name in _APPENDED:
        after[name] = after[name].unionByName(getattr(result, name)())
    log = "stock_transaction"
    columns = schemas.table_schema(log).fieldNames()
    after[log] = after[log].select(*columns).unionByName(result.ledger().select(*columns))
    return after


def write_replay(result: Replay, folder: str) -> None:
    """Write a replay's outcome as a new, whole snapshot that ``load_tables`` reads, and its ``rejects``.

    ``folder`` must be another than the one the replay was read from.
    """
    write_tables(next_tables(result), folder)
    result.rejects().write.mode("overwrite").parquet(f"{folder}/rejects")


def commit_replay(result: Replay, store: Snapshots, batch: str | None = None) -> int:
    """Make a replay the store's next version: changed buckets, added documents, log rows and decisions.

    The replay must have been read from the current version. A table no accepted command touches is not written.
    ``batch`` names the version; a batch that has been committed before is left alone.
    """
    done = store.version_of(batch) if batch is not None else None
    if done is not None:
        return done
    accepted = result.accepted()
    received, shipped = accepted.where(kind_is("RECEIVE")), accepted.where(kind_is("SHIP"))
    buckets = touched_buckets({
        "inventory": accepted.select("product_id"),
        "po_line": received.select("line_id"), "purchase_order": received.select("order_id"),
        "so_line": shipped.select("line_id"), "sales_order": shipped.select("order_id"),
    })
    opened = {
        "goods_receipt": buckets["po_line"], "goods_receipt_line": buckets["po_line"],
        "shipment": buckets["so_line"], "shipment_line": buckets["so_line"],
    }
    changed = {name: (getattr(result, name)(), own) for name, own in buckets.items() if own}
    moved = accepted.where(kind_is("TRANSFER")).isEmpty()
    names = [n for n in _APPENDED if (opened[n] if n in opened else not moved)]
    added = {name: getattr(result, name)() for name in names}
    if buckets["inventory"]:
        added["stock_transaction"] = result.ledger()
    added[DECISIONS] = result.outcomes.select(
        "seq", "cmd", "code", reason_name().alias("reason"), "src_before", "dst_before", F.lit(batch).cast("string").alias("batch")
    )
    return store.commit(changed, added, batch)
