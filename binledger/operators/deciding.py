"""Deciding prepared movements in parallel, also where one product has most of them.

A movement touches slots and order lines of one product, so products are independent of each other and
most are folded in one go, dealt by product. A product with more than its share of the
commands is cut in time, between quantiles of its own ``seq``, into as many stretches as it has shares.

All stretches are folded at once, each from openings that are guessed at first. A folded stretch
is a function of its openings, known near the one it was folded from: a slot or line that turned nothing down moves by
the same amount from nearby openings too, and one that did has met its limit, so that it ends where it ended. These
functions, shifts and constants, are composed along each slot and line by prefix windows, which gives the next openings;
stretches whose openings change are folded again. When none changes, every stretch was folded from
exactly what the one before ended with, which is the sequential result. The functions only speed this up: the first stretch
with a wrong opening gets its right one in the next round, so the loop ends, at worst after as many rounds as stretches:
that is what a product takes whose slots are all near zero and coupled by transfers, where every decision hangs on the one before.

Every round writes its decisions to the shared folder. The driver holds numbers of stretches and of rounds, at most
two for each of ``STRETCHES``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binledger.functions import fold
from binledger.functions.fold import CLOSING_DDL, FIELDS, KINDS, fold_sorted
from binledger.session import cut

# The helper travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(fold)

#: A share is this part of all commands, or CHUNK_ROWS commands if that is more.
STRETCHES = 32
CHUNK_ROWS = 1 << 14
_KEY = ["product_id", "kind", "a", "b"]
_DECISION = ["code", "src_before", "dst_before"]


def kind_is(*names: str) -> Column:
    return F.col("kind").isin(*[KINDS.index(n) for n in names])


def _milli(column: str) -> Column:
    return (F.col(column) * 1000).cast("bigint")


def _as_rows(given: dict[str, Column], rows: DataFrame, like: T.StructType) -> DataFrame:
    """Openings in the shape of prepared commands."""
    return rows.select(
        *[
            given.get(f.name, F.lit(0 if f.name in FIELDS else None)).cast(f.dataType).alias(f.name)
            for f in like.fields
        ]
    )


def _stored(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """``(product_id, kind, a, b, start, reserved)`` of the stored slots of some products."""
    held = inventory.join(products, "product_id", "left_semi")
    return held.select(
        "product_id", F.lit(0).cast("bigint").alias("kind"), F.col("warehouse_id").alias("a"), F.col("location_id").alias("b"),
        _milli("qty_on_hand").alias("start"), _milli("qty_reserved").alias("reserved"),
    )


def _opening_rows(openings: DataFrame, like: T.StructType) -> DataFrame:
    """Rows for the fold from ``(product_id, chunk, kind, a, b, on_hand, shipped, exists, reserved)``."""
    slot = F.col("kind") == 0
    return _as_rows(
        {
            "kind": F.when(slot, KINDS.index("OPEN")).otherwise(KINDS.index("OPEN_LINE")),
            "product_id": F.col("product_id"), "chunk": F.col("chunk"),
            "src_wh": F.when(slot, F.col("a")).otherwise(0), "src_loc": F.when(slot, F.col("b")).otherwise(0),
            "dst_wh": F.when(slot, 0).otherwise(F.col("kind")), "line": F.when(slot, 0).otherwise(F.col("a")),
            "milli": F.when(slot, 0).otherwise(F.col("on_hand")),
            "src_on_hand": F.when(slot, F.col("on_hand")).otherwise(0),
            "src_shipped": F.col("shipped"), "src_reserved": F.col("reserved"), "src_exists": F.col("exists"),
        },
        openings, like,
    )


def _folded(commands: DataFrame, openings: DataFrame, label: str) -> DataFrame:
    rows = commands.withColumn("__turn", F.lit(1)).unionByName(openings.withColumn("__turn", F.lit(0)))
    ordered = rows.repartition("product_id", "chunk").sortWithinPartitions("product_id", "chunk", "__turn", "seq")
    schema = T.StructType([
        *(T.StructField(f.name, f.dataType) for f in rows.schema.fields),  # closings leave most of them NULL
        *(T.StructField(c, T.LongType()) for c in _DECISION),
        *T.StructType.fromDDL(f"closing struct<{CLOSING_DDL}>").fields,
    ])
    return cut(ordered.mapInArrow(fold_sorted, schema).drop("__turn"), label)


def _touched(commands: DataFrame) -> DataFrame:
    """Per stretch, every slot and line it touches with the change if all its sound commands were accepted, and what a line has left."""
    q = F.col("milli")
    sound = (F.col("early") == 0) & (F.col("middle") == 0) & (F.col("late") == 0)

    def part(kind, a, b, change: Column, left: Column) -> Column:
        return F.struct(
            F.lit(kind).cast("bigint").alias("kind") if isinstance(kind, int) else kind.alias("kind"), a.alias("a"), b.alias("b"),
            F.when(sound, change).otherwise(0).cast("bigint").alias("change"), left.cast("bigint").alias("left"),
        )

    none = F.lit(None)
    own = part(0, F.col("src_wh"), F.col("src_loc"), F.when(kind_is("SHIP", "TRANSFER"), -q).otherwise(q), none)
    far = part(0, F.col("dst_wh"), F.col("dst_loc"), q, none)
    line = part(F.col("kind"), F.col("line"), F.lit(0).cast("bigint"), q, F.col("line_ordered") - F.col("line_done"))
    parts = F.when(kind_is("TRANSFER"), F.array(own, far)).when(kind_is("RECEIVE", "SHIP"), F.array(own, line)).otherwise(F.array(own))
    return (
        commands.select("product_id", "chunk", F.explode(parts).alias("p")).select("product_id", "chunk", "p.*")
        .groupBy("product_id", "chunk", "kind", "a", "b")
        .agg(F.sum("change").alias("change"), F.max("left").alias("left"))
    )


def _guessed(commands: DataFrame, stored: DataFrame) -> DataFrame:
    """First openings: stored balances plus everything sound before, kept within what is possible."""
    before = Window.partitionBy(*_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum("change").over(before), F.lit(0))
    rows = _touched(commands).withColumns({"moved": moved, "later": F.coalesce(F.max(F.lit(1)).over(before), F.lit(0))})
    rows = rows.join(stored, _KEY, "left")
    start = F.coalesce("start", F.lit(0))
    possible = F.greatest(F.lit(0), F.when(F.col("kind") == 0, start + F.col("moved")).otherwise(F.least("moved", "left")))
    return rows.select(
        "product_id", "chunk", "kind", "a", "b", possible.cast("bigint").alias("on_hand"), F.lit(0).cast("bigint").alias("shipped"),
        F.greatest(F.col("start").isNotNull().cast("bigint"), (F.col("later") > 0).cast("bigint")).alias("exists"),
        F.coalesce("reserved", F.lit(0)).cast("bigint").alias("reserved"),
    )


def _composed(closings: DataFrame, stored: DataFrame) -> DataFrame:
    """The opening of every slot and line in every stretch that touches it, from the functions of the stretches before.

    ``changed`` tells where it differs from the one its stretch was folded from.
    """
    up_to = Window.partitionBy(*_KEY).orderBy("chunk")
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    moved = F.col("closed") - F.col("opened")
    summed = closings.withColumns({
        "moved": moved,
        "total": F.sum(moved).over(up_to.rowsBetween(Window.unboundedPreceding, 0)),
        "shipped": F.coalesce(F.sum(F.col("closed_shipped") - F.col("opened_shipped")).over(before), F.lit(0)),
        "existed": F.coalesce(F.max("closed_exists").over(before), F.lit(0)),
    })
    fixed = F.last(F.when(F.col("turned"), F.struct("closed", "total")), ignorenulls=True).over(before)
    rows = summed.withColumn("fixed", fixed).join(stored, _KEY, "left")
    on_hand = F.coalesce(F.col("fixed.closed"), F.col("start"), F.lit(0)) + (
        F.col("total") - F.col("moved") - F.coalesce(F.col("fixed.total"), F.lit(0))
    )
    exists = F.greatest(F.col("existed"), F.col("start").isNotNull().cast("bigint"), (F.col("kind") > 0).cast("bigint"))
    rows = rows.withColumns({"on_hand": on_hand.cast("bigint"), "exists": exists.cast("bigint"), "shipped": F.col("shipped").cast("bigint")})
    return rows.select(
        "product_id", "chunk", "kind", "a", "b", "on_hand", "shipped", "exists", F.coalesce("reserved", F.lit(0)).cast("bigint").alias("reserved"),
        ((F.col("on_hand") != F.col("opened")) | (F.col("shipped") != F.col("opened_shipped"))
         | (F.col("exists") != F.col("opened_exists"))).alias("changed"),
    )


def _with_stretches(prepared: DataFrame, chunk_rows: int) -> tuple[DataFrame, list[int]]:
    """``prepared`` with ``chunk`` (-1 where the product is folded whole), and the products that are cut."""
    n = prepared.count()
    pieces = max(1, min(STRETCHES, n // chunk_rows))
    heavy = {}
    if pieces > 1:
        counts = prepared.groupBy("product_id").count().where(F.col("count") > n / pieces)
        heavy = {r["product_id"]: r["count"] for r in counts.collect()}  # fewer than pieces
    if not heavy:
        return prepared.withColumn("chunk", F.lit(-1)), []
    own = prepared.where(F.col("product_id").isin(list(heavy))).groupBy("product_id")
    places = own.agg(F.percentile_approx("seq", [i / pieces for i in range(1, pieces)], 100 * pieces).alias("places")).collect()
    ends = []
    for product, at in ((r["product_id"], r["places"] or []) for r in places):
        shares = -(-heavy[product] * pieces // n)
        ends.append((product, sorted({at[-(-i * len(at) // shares)] for i in range(1, shares)} if at else set())))
    cuts = F.broadcast(prepared.sparkSession.createDataFrame(ends, "product_id bigint, ends array<bigint>"))  # fewer than pieces
    after = F.coalesce(F.size(F.filter("ends", lambda e: e < F.col("seq"))), F.lit(0))
    rows = prepared.join(cuts, "product_id", "left")
    return rows.select(*prepared.columns, F.when(F.col("ends").isNull(), -1).otherwise(after).alias("chunk")), list(heavy)


def decide(prepared: DataFrame, inventory: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``prepared``, read several times, with the code of every command and the balances before it."""
    spark, columns = prepared.sparkSession, prepared.columns
    rows, heavy = _with_stretches(prepared, chunk_rows)
    cold = F.col("chunk") < 0
    whole = _stored(inventory, rows.where(cold).select("product_id").distinct()).select(
        "*", F.lit(-1).alias("chunk"), F.col("start").alias("on_hand"), F.lit(0).alias("shipped"), F.lit(1).alias("exists")
    )
    openings = _opening_rows(whole, rows.schema)
    if not heavy:
        return _folded(rows, openings, "movement-decided").select(*columns, *_DECISION)

    named = spark.createDataFrame([(p,) for p in heavy], "product_id bigint")
    stored = cut(_stored(inventory, F.broadcast(named)), "movement-stored")  # fewer than STRETCHES products
    cut_up = cut(rows.where(~cold), "movement-stretches")
    guess = _opening_rows(_guessed(cut_up, stored), rows.schema)
    decided = [_folded(rows.where(cold).unionByName(cut_up), openings.unionByName(guess), "movement-decided")]
    closings = decided[0].where("closing IS NOT NULL").select("product_id", "chunk", "closing.*")
    last: dict[tuple[int, int], int] = {}
    while True:
        closings = cut(closings, "movement-closings")
        composed = cut(_composed(closings, stored), "movement-openings")
        again = [tuple(r) for r in composed.where("changed").select("product_id", "chunk").distinct().collect()]
        if not again:
            break
        last |= dict.fromkeys(again, len(decided))
        todo = F.broadcast(spark.createDataFrame(again, "product_id bigint, chunk int"))
        key = ["product_id", "chunk"]
        made = _folded(
            cut_up.join(todo, key, "left_semi"), _opening_rows(composed.join(todo, key, "left_semi"), rows.schema), "movement-decided"
        )
        decided.append(made)
        fresh = made.where("closing IS NOT NULL").select("product_id", "chunk", "closing.*")
        closings = closings.join(todo, key, "left_anti").unionByName(fresh)

    found = None
    for number, made in enumerate(decided):
        later = [k for k, r in last.items() if r > number] if not number else []
        own = [k for k, r in last.items() if r == number]
        made = made.where("closing IS NULL")
        if number and not own:
            continue
        if own or later:
            some = F.broadcast(spark.createDataFrame(own or later, "product_id bigint, chunk int"))
            made = made.join(some, ["product_id", "chunk"], "left_semi" if own else "left_anti")
        made = made.select(*columns, *_DECISION)
        found = made if found is None else found.unionByName(made)
    return found
