import duckdb
from collections import Counter

from binledger.llm import catalog, mixing


def compare(docs_frame, query_rows, connection):
    want = connection.execute(mixing.CHECK_SQL).fetchall()
    return sorted(map(tuple, query_rows), key=str), sorted(want, key=str)


def test_matches_check_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = catalog.op6_mixing_sources(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken").collect()
    got, want = compare(None, rows, connection)
    assert got == want
    taken, goal = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(v - k[1]) < 1 for k, v in taken.items())


def odd(spark):
    rows = [(i, "w " * (i % 7), "big", 1) for i in range(5000)]
    rows += [(9000, None, "a", 1), (9001, "", "b", 1), (None, "x y z", None, 1), (None, "x y", None, 1), (9002, "é ü", None, 2), (9002, "é ü", None, 2)]
    rows += [(9100 + i, "one two three", "tiny", 3) for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_odd_rows_and_capped_sources(spark):
    docs = odd(spark)
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    got, want = compare(None, mixing.mixed_sizes(docs).collect(), connection)
    assert got == want
    assert any(t == 3 * s for _, _, s, t, _ in got if s) and any(t < 3 * s for _, _, s, t, _ in got)
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0


def test_documents_follow_the_sizes(spark):
    docs = odd(spark)
    made = mixing.mixed_documents(docs.drop("size").withColumn("n_chars", __import__("pyspark").sql.functions.length("text")))
    words = Counter()
    for r in made.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.mixed_sizes(docs).collect():
        want[r.doc_id] += r.taken
    assert words == +want
