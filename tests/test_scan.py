"""Chunked scans give what one plain window gives, hot keys or not."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from binledger.functions import scan


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows under key 0, some under NULL."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 0).when(n % 50 == 1, None).otherwise(n % 40)
    return spark.range(1, 3001).select(
        n.alias("seq"), key.alias("key"), ((n * 37) % 101 - 50).alias("value")
    ).cache()


@pytest.mark.parametrize("span", [64, 10_000])
def test_running_sums(rows, span):
    got = scan.running_sums(rows, ["key"], ["seq"], {"total": F.col("value")}, span=span)
    window = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("total", F.sum("value").over(window))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("span", [64, 10_000])
def test_previous_value(rows, span):
    got = scan.previous_value(rows, ["key"], "seq", "value", "before", span)
    want = rows.withColumn("before", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_number_rows(rows):
    levels = [scan.whole_quotient(F.col("seq"), 1000), scan.whole_quotient(F.col("seq"), 70)]
    some = rows.where(F.col("value") > 0)
    got = scan.number_rows(some, levels, ["seq"], "n")
    want = some.withColumn("n", F.row_number().over(Window.orderBy("seq")).cast("bigint"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_number_rows_within(rows):
    some = rows.withColumn("kind", F.col("seq") % 4)
    got = scan.number_rows(
        some, [scan.whole_quotient(F.col("seq"), 100)], ["seq"], "n", within=["kind"]
    )
    window = Window.partitionBy("kind").orderBy("seq")
    want = some.withColumn("n", F.row_number().over(window).cast("bigint"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_number_rows_keeps_null_and_sparse_positions(spark):
    rows = spark.createDataFrame([(None, 9), (5, 1), (1 << 62, 3), (-7, 0), (1 << 40, 2)], "seq long, want int")
    got = scan.number_rows(rows, scan.id_levels(F.col("seq")), ["seq"], "n").collect()
    assert [r.want for r in sorted(got, key=lambda r: r.n)] == [0, 1, 2, 3, 9] and len(got) == 5


def test_sums_nobody_reads_cost_nothing(rows):
    """Only keys with very many rows meet totals, by a join that goes where the sums go."""
    got = scan.running_sums(rows, ["key"], ["seq"], {"total": F.col("value")}, span=64).select("seq")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert sorted(r.seq for r in got.collect()) == list(range(1, 3001))


@pytest.mark.parametrize("crowd", [900, 1100])
def test_keys_up_to_a_crowd_stay_whole(rows, crowd):
    got = scan.running_sums(rows, ["key"], ["seq"], {"total": F.col("value")}, span=64, crowd=crowd, counted=rows.select("key"))
    window = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("total", F.sum("value").over(window))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
