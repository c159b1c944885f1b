"""Tables over written lines are those derived lazily; work tables and shuffle files go when they are done with."""

import datetime
import os
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger import schemas
from binledger.operators import kept, movements
from binledger.session import cut, ensure_checkpoint_dir
from binledger.sources.snapshots import Snapshots
from binledger.sources.testdata import RAW_DDL, DerivedTables, UncleanTables
from binledger.streaming import movements as streaming
from tests.test_movements_random import COLUMNS, batch


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Orders that repeat with another status or as they are, are missing or have no key; lines without order or part."""
    day = datetime.datetime(1995, 3, 1)
    lines = [
        (key, (key or 7) * 3 % 11 if i != 2 else None, i, i, float(i + 1), 100.0 * (i + 1), 0.0, 0.0, "ANR"[i % 3], "OF"[i % 2], day + datetime.timedelta(days=i))
        for key in (1, 2, 3, 4, None) for i in range(5)
    ]
    orders = [(1, 1, "F", 1.0, day, "4-LOW"), (1, 2, "P", 1.0, day, "3-MID"), (2, 1, "P", 1.0, day, "3-MID"), (2, 1, "P", 1.0, day, "3-MID"),
              (4, 1, None, 1.0, day, "4-LOW"), (None, 1, "F", 1.0, day, "4-LOW")]
    folder = tmp_path_factory.mktemp("odd")
    for name, rows in (("lineitem", lines), ("orders", orders)):
        spark.createDataFrame(rows, RAW_DDL[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["po_line", "so_line", "stock_transfer_line", "stock_transaction"])
def test_written_lines_give_the_same_tables(spark, odd, name):
    for source in (DerivedTables, UncleanTables):
        got, want = source(spark, odd, written=True)[name], source(spark, odd)[name]
        assert got.dtypes == want.dtypes and want.count() > 0
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_shuffle_files_go_with_the_statement(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(f) for f in (files.apply(i).getName() for i in range(files.size())) if f.endswith(".data")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = held(), spark.conf.get(setting)
    cut(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(setting) == was


def test_a_table_is_written_without_a_second_look(spark, seeded, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "isEmpty", lambda df: pytest.fail("rows computed again to see whether there are any"))
    store = Snapshots(spark, str(tmp_path))
    assert store._placed("po_line", seeded["po_line"].where("false"), range(16)) == []
    assert store._placed("po_line", seeded["po_line"], range(16))


def test_flags_of_odd_references(spark, seeded):
    """Unknown, repeated and NULL references give what joins with the parents give, row by row."""
    employees = seeded["employee"].where("employee_id <> 2").unionAll(seeded["employee"].where("employee_id = 1"))
    bins = seeded["warehouse_location"].where("location_id <> 1")
    t = {**seeded, "employee": employees, "warehouse_location": bins}
    commands = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in batch(5, 60)], schemas.movement_schema())
    commands = cut(commands.withColumn("header_id", F.when(F.col("seq") % 5 == 0, 1).when(F.col("seq") % 7 == 0, 99).cast("bigint")))
    lined = cut(movements._with_lines(commands, t))
    odd = movements._odd_references(commands, lined, t)
    faulty = F.col("seq").isNull()
    got = movements._checked(movements._with_odd(lined, cut(odd)), faulty)
    want = movements.prepare(commands, t, faulty)
    columns = [c for c in want.columns if c not in ("may_create",)]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert odd.where("parent = 'employee' AND n = 2").count() == 1 and odd.where("parent = 'seq'").isEmpty()


def test_a_stream_leaves_no_work_tables(spark, seeded, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    store.create(seeded)
    commands = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in batch(3, 40)], schemas.movement_schema())
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    streaming.apply_batch(commands, store, "s/0", F.lit("2025-05-01 00:00:00").cast("timestamp"))
    left = {n for n in set(os.listdir(folder)) - before if n.startswith("movement-")}
    assert all(n.startswith(("movement-odd", "movement-counted", "movement-opened")) for n in left), left


def test_deltas_are_written_once(spark, seeded):
    commands = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in batch(4, 40)], schemas.movement_schema())
    result = movements.replay(commands, seeded, F.lit("2025-05-01 00:00:00").cast("timestamp"))
    after = kept.after_replay(kept.compute(seeded), result)
    assert any("kept-stock-delta" in f for f in after["value"].inputFiles())
    assert not any("movement-" in f for f in after["value"].inputFiles())
