"""Aggregates that batches and product changes move on equal those computed anew."""

from decimal import Decimal

from pyspark.sql import functions as F

from binledger import schemas
from binledger.operators import kept, movements, views
from binledger.sources.snapshots import Snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(got, want):
    for name in kept.KEYS:
        columns = want[name].columns
        assert rows(got[name].select(*columns)) == rows(want[name]), name


def test_products_come_change_and_go(spark, seeded):
    stored = kept.compute(seeded)
    key = F.col("product_id")
    products = seeded["product"].where(key != 2).withColumns({
        "unit_cost": F.when(key == 1, Decimal("99.50")).otherwise(F.col("unit_cost")).cast("decimal(12,2)"),
        "is_active": F.when(key == 3, "N").otherwise(F.col("is_active")),
        "category_id": F.when(key == 4, 1).otherwise(F.col("category_id")).cast("bigint"),
    })
    changed = {**seeded, "product": products}
    after = kept.after_products(stored, seeded, products)
    same(after, kept.compute(changed))
    assert rows(kept.stock_valuation(after, changed)) == rows(views.stock_valuation(changed))
    same(kept.after_products(after, changed, seeded["product"]), stored)  # and back again


def test_a_group_goes_with_its_last_row(spark):
    ddl = "k int, n bigint, total decimal(18,3)"
    one = Decimal("1.000")
    stored = spark.createDataFrame([(1, 2, one), (2, 1, one), (None, 1, one)], ddl)
    delta = spark.createDataFrame([(2, -1, -one), (3, 1, one), (None, 1, one)], ddl)
    assert rows(kept.merged(stored, delta, ["k"])) == sorted([(1, 2, one), (3, 1, one), (None, 2, 2 * one)], key=str)
    assert rows(kept.merged(stored, delta.limit(0), ["k"])) == rows(stored)


def test_a_batch_that_lost_its_aggregates_has_them_computed(spark, seeded, tmp_path):
    """New slots, closed orders and shipments; the next version's aggregates are found, or made where they are lost."""
    store = Snapshots(spark, str(tmp_path))
    store.create(seeded)
    t = store.load()
    line = t["po_line"].first()
    sold = t["so_line"].first()
    raw = [
        (1, "RECEIVE", line["po_line_id"], None, None, 1, None, None, line["qty_ordered"] - line["qty_received"]),
        (2, "ADJUST", None, 1, 1, 1, None, None, Decimal(7)),
        (3, "SHIP", sold["so_line_id"], None, None, 1, None, None, Decimal(1)),
        (4, "ADJUST", None, 1, 1, 1, None, None, Decimal(-10**6)),
    ]
    ddl = ("seq bigint, cmd string, line_id bigint, product_id bigint, warehouse_id bigint, location_id bigint, "
           "to_warehouse_id bigint, to_location_id bigint, qty decimal(12,3)")
    given = spark.createDataFrame(raw, ddl)
    for f in schemas.movement_schema().fields:
        if f.name not in given.columns:
            given = given.withColumn(f.name, F.lit(None).cast(f.dataType))
    given = given.select(*schemas.movement_schema().fieldNames())
    result = movements.replay(given, t, F.lit("2025-05-01").cast("timestamp"))
    assert result.accepted().count() >= 2
    after = kept.after_replay(kept.load(store), result)
    version = movements.commit_replay(result, store)
    same(after, kept.compute(store.load()))
    made = kept.load(store)  # nobody saved it: computed
    same(made, kept.compute(store.load()))
    same(kept.load(store, version), made)
    same(kept.after_replay(made, movements.replay(given.limit(0), store.load(), F.lit("2025-05-02").cast("timestamp"))), made)
