"""A stream of small files does what one batch does, also when it fails in between."""

from pyspark.sql import functions as F
from pyspark.errors import StreamingQueryException

import pytest

from binledger import schemas
from binledger.operators import movements
from binledger.sources.snapshots import DECISIONS, Snapshots
from binledger.streaming import movements as streaming
from tests.test_movements_random import COLUMNS, batch, model



@pytest.fixture(scope="module")
def now(spark):
    return F.lit("2025-05-01 00:00:00").cast("timestamp")


def test_stream_equals_batch_over_a_failure(spark, seeded, tmp_path, monkeypatch, now):
    rows = batch(11, 90)
    for i in range(3):
        part = [tuple(r.get(c) for c in COLUMNS) for r in rows[i * 30 : (i + 1) * 30]]
        frame = spark.createDataFrame(part, schemas.movement_schema()).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    source = (
        spark.readStream.schema(schemas.movement_schema())
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.create(seeded) == 1

    real = streaming.apply_batch

    def fails_after_commit(commands, where, name, now=None):
        made = real(commands, where, name, now)
        if name.endswith("/1"):
            raise RuntimeError("lost after the commit")
        return made

    monkeypatch.setattr(streaming, "apply_batch", fails_after_commit)
    with pytest.raises(StreamingQueryException):
        streaming.start(source, store, "s", str(tmp_path / "state"), now).awaitTermination(300)
    assert store.current() == 3
    monkeypatch.setattr(streaming, "apply_batch", real)
    assert streaming.start(source, store, "s", str(tmp_path / "state"), now).awaitTermination(300)
    assert store.current() == 4 and [store.version_of(f"s/{i}") for i in range(3)] == [2, 3, 4]

    verdicts, slots = model(rows)
    after = store.load()
    assert {r.seq: r.reason for r in after[DECISIONS].collect()} == verdicts
    got = {(r.product_id, r.warehouse_id, r.location_id): (r.qty_on_hand, r.qty_reserved) for r in after["inventory"].collect()}
    assert got == slots
    commands = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], schemas.movement_schema()).coalesce(1)
    whole = movements.replay(commands, seeded, now)
    top = seeded["stock_transaction"].count()
    columns = [c for c in schemas.table_schema("stock_transaction").fieldNames()]
    ledger = after["stock_transaction"].select(*columns)
    assert ledger.count() == top + whole.ledger().count()
    assert ledger.subtract(seeded["stock_transaction"].select(*columns)).exceptAll(whole.ledger().select(*columns)).isEmpty()
    for table in ("purchase_order", "sales_order", "po_line", "so_line", "goods_receipt", "shipment", "stock_transfer"):
        want = movements.next_tables(whole)[table]
        assert sorted(map(str, after[table].drop("updated_at").collect())) == sorted(map(str, want.drop("updated_at").collect()))


def test_versions_share_what_they_do_not_change(spark, seeded, tmp_path, now):
    store = Snapshots(spark, str(tmp_path / "store"))
    first = store.create(seeded)
    row = {"seq": 1, "cmd": "ADJUST", "product_id": 1, "warehouse_id": 1, "location_id": 1, "qty": 5, "employee_id": 1}
    commands = spark.createDataFrame([tuple(row.get(c) for c in COLUMNS)], schemas.MOVEMENT_DDL.replace("DECIMAL(12,3)", "INT"))
    commands = commands.withColumn("qty", F.col("qty").cast("decimal(12,3)"))
    second = streaming.apply_batch(commands, store, "one", now)
    assert streaming.apply_batch(commands, store, "one", now) == second == store.current()
    old, new = store.parts(first), store.parts(second)
    differs = {t for t in new if new[t] != old[t]}
    assert differs == {"inventory", "stock_transaction", DECISIONS}
    assert len(set(new["inventory"]) - set(old["inventory"])) == 1  # one bucket
    assert set(old["stock_transaction"]) < set(new["stock_transaction"])
    assert store.load(first)["inventory"].count() == seeded["inventory"].count()
    hand = store.load()["inventory"].where("product_id = 1 AND warehouse_id = 1 AND location_id = 1").first().qty_on_hand
    assert hand == seeded["inventory"].where("product_id = 1 AND warehouse_id = 1 AND location_id = 1").first().qty_on_hand + 5
    third = store.compact("stock_transaction")
    assert len(store.parts(third)["stock_transaction"]) == 1
    assert store.load()["stock_transaction"].count() == seeded["stock_transaction"].count() + 1
    with pytest.raises(ValueError):
        store.load(99)
    plan = store.log_months().where("transaction_month = '2025-04'")._jdf.queryExecution().toString()
    assert "transaction_month" in plan.split("PartitionFilters")[1][:200]
