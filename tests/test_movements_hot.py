"""A product with a third of all commands, near zero stock, against a plain sequential model."""

from collections import Counter

from pyspark.sql import functions as F

from binledger.functions.fold import CODE
from binledger.operators import deciding, movements
from binledger.operators.keys import upsert

import pytest


def slots_of(derived, product):
    held = derived["inventory"].where(F.col("product_id") == product).collect()
    return {(r.warehouse_id, r.location_id): [r.qty_on_hand, r.qty_reserved] for r in held}


def test_hot_product_is_cut_and_decided_in_order(derived, monkeypatch):
    stretches = Counter()
    real = deciding._folded

    def counted(commands, openings, label):
        made = real(commands, openings, label)
        for r in made.where("closing IS NULL AND chunk >= 0").groupBy("chunk").count().collect():
            stretches[r["chunk"]] = max(stretches[r["chunk"]], r["count"])
        return made

    monkeypatch.setattr(deciding, "_folded", counted)
    decided = movements.outcomes(derived.hot_command, derived, chunk_rows=200).where("product_id = 1").cache()
    n = derived.hot_command.count()
    assert n > 5000 and len(stretches) > 8 and max(stretches.values()) < 0.05 * n

    hand = {k: v[0] for k, v in slots_of(derived, 1).items()}
    got = {r.seq: (r.code == 0, r.src_before) for r in decided.where("kind IN (3, 4) AND early = 0 AND middle = 0 AND late = 0").collect()}
    lines = {r.seq: r for r in decided.collect()}
    for seq in sorted(lines):
        r = lines[seq]
        if seq not in got:
            if r.code == 0:  # receipts and shipments of this product move stock too
                slot = (r.src_wh, r.src_loc)
                hand[slot] = hand.get(slot, 0) + (r.milli if r.kind == 1 else -r.milli) / 1000
            continue
        slot = (r.src_wh, r.src_loc)
        before = hand.get(slot)
        change = r.milli / 1000 if r.kind == 3 else -r.milli / 1000
        if got[seq][0]:
            assert float(before or 0) * 1000 == got[seq][1] and float(before or 0) + change >= 0
            hand[slot] = float(before or 0) + change
            if r.kind == 4:
                far = (r.dst_wh, r.dst_loc)
                hand[far] = float(hand.get(far, 0)) + r.milli / 1000
        else:
            assert before is None and change < 0 or float(before or 0) + change < 0 or r.code == CODE["BELOW_RESERVED"], seq


def test_stretches_decide_as_one_fold(derived):
    columns = ("seq", "code", "src_before", "dst_before")
    cut = movements.outcomes(derived.hot_command, derived, chunk_rows=500).select(*columns)
    whole = movements.outcomes(derived.hot_command, derived, chunk_rows=1 << 30).select(*columns)
    assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()


def test_repeated_or_missing_keys_in_changes_are_errors(spark, seeded):
    now = F.lit("2025-05-01 00:00:00").cast("timestamp")
    for rows in ([(1, "A"), (1, "B")], [(None, "A")]):
        changes = spark.createDataFrame(rows, "product_id bigint, sku string")
        with pytest.raises(Exception, match="product_id"):
            upsert(seeded["product"], changes, "product_id", now).collect()
    latest = spark.createDataFrame([(1, "A", 2, None), (1, "B", 1, None), (2, "C", 5, True)], "product_id bigint, sku string, n int, gone boolean")
    made = {r.product_id: r.sku for r in upsert(seeded["product"], latest, "product_id", now, "n", "gone").collect()}
    assert made[1] == "A" and 2 not in made and len(made) == seeded["product"].count() - 1
