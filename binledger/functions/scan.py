"""Ordered scans over keyed rows that stay parallel when one key is huge.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the rows of a
key that may have very many are cut into chunks of consecutive positions; each chunk is scanned on its
own and a table of per-chunk totals carries the result of the earlier chunks forward. Which keys these are tells a
count of rows per hash of the key, of which there are ``HASHES``; all others have one chunk and no totals. There is one plan for all sizes.
Keys and chunk form one struct, in which NULLs are equal, so scan and join share a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20
HASHES = 1 << 16
_AT = "__at"
_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def whole_quotient(value: Column, divisor: int) -> Column:
    """Integer division, exact for any bigint."""
    return F.call_function("div", value, F.lit(divisor))


def left_join(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on null-safe equality that keeps the key columns of ``left`` only."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in columns})
    same = reduce(
        lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in columns)
    )
    return left.join(renamed, same, "left").drop(*[f"__r_{c}" for c in columns])


def id_levels(value: Column, span: int = CHUNK_ROWS) -> list[Column]:
    """Levels for ``number_rows`` over any bigint, however sparse: no level has over 2^19 values in a range."""
    return [whole_quotient(value, 1 << 44), whole_quotient(value, 1 << 32), whole_quotient(value, span)]


def _placed(
    df: DataFrame, keys: Sequence[str], position: Column, span: int, crowd: int | None, counted: DataFrame | None
) -> DataFrame:
    """``df`` with its chunk, and in ``__crowded`` whether the key may have over ``crowd`` rows and so several of them."""
    hashed = F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("__hash")
    counts = (df if counted is None else counted).select(hashed).groupBy("__hash").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.where(F.col("n") > (span if crowd is None else crowd)).select("__hash", F.lit(True).alias("__crowded"))
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.withColumn("__hash", hashed).join(F.broadcast(crowded), "__hash", "left").drop("__hash")  # at most HASHES
    chunk = F.when(F.col("__crowded"), whole_quotient(position, span))
    return rows.withColumn(_AT, F.struct(*parts, chunk.alias("chunk")))


def _over_chunks(keys: Sequence[str]):
    return Window.partitionBy(*[F.col(_AT)[f"k{i}"] for i in range(len(keys))]).orderBy(F.col(_AT)["chunk"])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    position: Column | None = None,
    span: int = CHUNK_ROWS,
    crowd: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add running sums per key, the current row included.

    ``sums`` maps each new column to the non-null expression added up. ``position``
    (default: the first order column) is a bigint that never falls along ``order``;
    a chunk holds ``span`` consecutive positions. Keys with up to ``crowd`` rows (default: ``span``) stay whole.
    ``counted``, if given, has the same keys in the same number of rows as ``df`` and is cheaper to count.
    """
    names = list(sums)
    at = F.col(order[0]) if position is None else position
    rows = _placed(df, keys, at, span, crowd, counted).withColumns({f"__v_{n}": sums[n] for n in names})
    totals = rows.where("__crowded").groupBy(_AT).agg(*[F.sum(f"__v_{n}").alias(f"__o_{n}") for n in names])
    earlier = _over_chunks(keys).rowsBetween(*_BEFORE)
    carried = totals.withColumns({f"__o_{n}": F.coalesce(F.sum(f"__o_{n}").over(earlier), F.lit(0)) for n in names})
    inside = Window.partitionBy(_AT).orderBy(*order).rowsBetween(*_UP_TO_HERE)
    local = rows.withColumns({n: F.sum(f"__v_{n}").over(inside) for n in names})
    joined = local.join(carried, _AT, "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"__o_{n}", F.lit(0)) for n in names}).select(*df.columns, *names)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, span: int = CHUNK_ROWS
) -> DataFrame:
    """Add the ``value`` of the preceding row of the key, NULL on its first row.

    ``order`` is a unique bigint column.
    """
    rows = _placed(df, keys, F.col(order), span, None, None)
    last = rows.where("__crowded").groupBy(_AT).agg(F.max_by(F.struct(F.col(value)), F.col(order)).alias("__last"))
    carried = last.withColumn("__last", F.lag("__last").over(_over_chunks(keys)))
    inside = Window.partitionBy(_AT).orderBy(order)
    local = rows.withColumn("__lagged", F.lag(F.struct(F.col(value))).over(inside))
    joined = local.join(carried, _AT, "left")
    return joined.withColumn(name, F.coalesce("__lagged", "__last")[value]).select(*df.columns, name)


def number_rows(
    df: DataFrame,
    levels: Sequence[Column],
    order: Sequence[str],
    name: str,
    within: Sequence[str] = (),
) -> DataFrame:
    """Number rows 1, 2, 3, … in one order, per ``within`` if given, without one big window.

    ``levels`` cut the order into ranges from coarse to fine: rows of an earlier
    range come first in ``order``. Only the counts of one range's parts meet in one task;
    the rows themselves are sorted per finest range. NULLs come last, in levels and order.
    """
    groups, marks = [f"w{i}" for i in range(len(within))], [f"l{i}" for i in range(len(levels))]
    parts = [F.col(c).alias(g) for c, g in zip(within, groups)] + [v.alias(m) for v, m in zip(levels, marks, strict=True)]
    rows = df.withColumn(_AT, F.struct(*parts))
    table = rows.groupBy(_AT).agg(F.count(F.lit(1)).alias("__n")).withColumn("__shift", F.lit(0).cast("bigint"))
    for depth in range(1, len(marks) + 1):
        names = [*groups, *marks[:depth]]
        key = F.struct(*[F.col(_AT)[n].alias(n) for n in names])
        table = table.withColumn("__k", key)
        sizes = table.groupBy("__k").agg(F.sum("__n").alias("__size"))
        fields = [F.col("__k")[n] for n in names]
        earlier = Window.partitionBy(*fields[:-1]).orderBy(fields[-1].asc_nulls_last()).rowsBetween(*_BEFORE)
        offsets = sizes.select("__k", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__o"))
        table = table.join(offsets, "__k").withColumn("__shift", F.col("__shift") + F.col("__o")).select(_AT, "__n", "__shift")
    inside = Window.partitionBy(_AT).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        rows.join(table.select(_AT, "__shift"), _AT)
        .withColumn(name, (F.row_number().over(inside) + F.col("__shift")).cast("bigint"))
        .select(*df.columns, name)
    )
