"""Running totals inside groups of any size, over rows in the order of a random hex key.

A group's rows are range-cut by their key into ranges of about ``RANGE_ROWS`` rows. Sums per range are
pre-aggregated and carried forward; only a range is ever sorted in one task, so a group that
holds a third of all rows is as parallel as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binledger.session import cut

RANGE_ROWS = 2000
#: A table of one narrow row per group is broadcast up to this many groups, and joined by sorting beyond.
BROADCAST_GROUPS = 50_000


def per_group(table: DataFrame, label: str) -> DataFrame:
    """A written table of one narrow row per group, to be broadcast if its counted size allows it."""
    table = cut(table, label)
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def hex_key(*parts: Column | str, salt: str) -> Column:
    """A hash-random key, equal for equal parts: 32 hex digits that any engine computes alike."""
    texts = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(salt), *texts).cast("binary"))


def running_totals(rows: DataFrame, group: str, key: str, value: str, ties: list[str], before: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over rows of the same group that come earlier.

    Order is by ``key``, then ``ties``; ``group`` must not be null. ``rows`` is read three times,
    so it should be a written table or cheap to compute.
    """
    at = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    counts = per_group(rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(RANGE_ROWS)).alias("_ranges")), "ranges")
    placed = rows.join(counts, group).withColumn("_range", F.floor(at * F.col("_ranges"))).drop("_ranges")
    sums = placed.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(sums, [group, "_range"])
        .withColumn(before, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_offset")
    )
