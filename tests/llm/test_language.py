import zlib

from binledger.llm import catalog, language


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.op1_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.1 * len(rows)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(40)] + [(i, "der Hund und die Katze " * 5, "de") for i in range(40, 80)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 3!? \n", None), (None, "und die Katze", "zz"), (104, "DER HUND", None),
             (105, "the " * 200_000, None), (105, "the dog", None), (106, "漢字" * 9, None), (107, "𐐀𐐁", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS held_out")
    got = {(r.doc_id, i): r for i, r in enumerate(language.identify(docs).orderBy("doc_id", "score").collect())}
    by = {d: r for (d, _), r in got.items()}
    assert len(got) == len(rows)
    assert [by[d].lang_pred for d in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[None].lang_pred == "de" and by[104].lang_pred == "de" and by[105].lang_pred == "en"
    assert by[106].rejected and by[107].rejected and by[107].lang_pred in ("de", "en")
    unlabelled = language.identify(docs.withColumn("lang", language.F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
