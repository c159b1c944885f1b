import gzip
import hashlib
import os

import duckdb

from binledger.llm import catalog, warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip_matches_check_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = connection.execute(warc.CHECK_SQL).fetchall()
    got = catalog.op4_warc_capture_index(spark, sf_dir).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark):
    big = "<p>" + "é" * 200 + "</p>"
    rows = [(1, "http://A.b.com:80/x?q=1#f", big, 1), (2, "http://a.b.com/x?q=1", big, 1), (3, None, big, 1), (None, "x\r\ny", big, 1),
            (4, "https://c.org", None, 1), (5, "", "", 1), (6, "http://u@d.net/", "short", 1), (7, "http://u@d.net/", "short", 1),
            (8, "//e.f/é", "z" * 500_000, 1), (9, "http://g.h/", "q" * 120, 2), (9, "http://g.h/", "q" * 120, 2), (11, "http://g.h/", "q" * 120, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((tuple(r) for r in warc.archived_pages(pages, parts=3).select(*COLUMNS).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        head = {"<": 1, "q": 9}.get(html[0] if html and len(raw) >= 100 and html[0] in "<q" else None)
        again = head is not None and page != head
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", head if again else None))
    assert got == sorted(want, key=str)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_lookup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 7)
    rows = [(i, f"http://h{i % 5}.example.com/p{i % 40}", f"page {i} " * 30) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(pages, parts=4)
    assert archive.parts.agg({"captures": "sum"}).first()[0] == 400
    for url in ("http://h3.example.com/p13", "http://h0.example.com/p0"):
        want = sorted(html for _, u, html in rows if u == url)
        assert sorted(p.decode() for _, p in warc.lookup(archive, url)) == want
    assert warc.lookup(archive, "http://h9.example.com/none") == []
    folder = archive.root.removeprefix("file:")
    whole = b"".join(gzip.open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.endswith(".warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: response") == 400
