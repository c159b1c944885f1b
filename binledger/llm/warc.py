"""WARC archives with a two-level capture index.

**Writing.** Pages are range-partitioned and sorted by (reversed-host URL key, page_id). Each task writes one
archive, a gzip member per record, and beside it an index part: captures in key order in
compressed blocks of ``BLOCK_CAPTURES``, and the part's sparse directory with the first capture of each block.
The first captures of all parts, one row per archive, form the top directory, written as a table.

**Reading.** A look-up finds its part by binary search in the top directory; look-ups meet their part in one
shuffle of narrow rows. There they come in key order: binary search in the part's directory, a range
read of the block, binary search in the block, a range read of the record.

Archives lie in the shared folder; every attempt of a task writes files of its own name, and only those named in the
committed table are read, so a lost or repeated task leaves no trace in the results.

Defined results: a null html is an empty payload; a null url has the key ``)`` and no target; a null page_id is
never referred to while another holds the payload, and sorts first; rows that repeat page_id and payload
of a response are responses too; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger.llm.words import bound_batches
from binledger.session import cut, ensure_checkpoint_dir

BLOCK_CAPTURES = 500
MIN_REVISIT_BYTES = 100
READ_AHEAD = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """A written archive: where it lies and its top directory (one row per part)."""

    root: str
    parts: DataFrame


def url_key(url: str = "url") -> Column:
    """``http://a.b.com/x?y#z`` as ``com,b,a)/x?y``; built-in functions only."""
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(text, pattern, 1))
    rest = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(text)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest)


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _header(text: str | None) -> str:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url) -> bytes:
    """One WARC record, not compressed; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
             f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_header(url)}"] * (url is not None) + [f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, refers_url)}", f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page: {page_id}"] * (page_id is not None)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises if its lengths don't agree."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
    if raw[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return headers, block[block.index(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block


def _gzip(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed where they are read, so that both shuffles carry fewer bytes."""
    for batch in batches:
        bodies = pa.array([zlib.compress(b.as_py(), 1) for b in batch.column("html")], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bodies], schema=pa.schema([*list(batch.schema)[:-1], ("html", pa.binary())]))


def _place(key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    """What captures are ordered by: like Spark, keys by bytes and null first."""
    return key.encode(), page_id is not None, page_id or 0


def write_archive(pages: DataFrame, parts: int | None = None) -> Archive:
    """Write every row of ``pages`` as a record. ``parts`` archives; by default Spark decides."""
    spark = pages.sparkSession
    bound_batches(spark)
    root = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).select(
        "page_id", "url", url_key().alias("key"), "html", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")
    )
    heads = (
        rows.where(f"size >= {MIN_REVISIT_BYTES} AND page_id IS NOT NULL")
        .groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("head"), F.count("*").alias("held"))
        .where("held > 1").select("digest", "head")
    )
    rows = rows.select("page_id", "url", "key", "digest", "html").mapInArrow(
        _squeezed, "page_id long, url string, key string, digest string, html binary"
    ).join(heads, "digest", "left")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head.page_id"))
    rows = rows.select(
        "key", "page_id", "url", "digest", F.when(again, F.lit(b"")).otherwise(F.col("html")).alias("html"),
        F.when(again, F.col("head.page_id")).alias("refers_to"), F.when(again, F.col("head.url")).alias("refers_url"),
    )
    rows = rows.repartitionByRange(*([parts] if parts else []), "key", "page_id").sortWithinPartitions("key", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, at, n = uuid.uuid4().hex, None, 0, 0
        directory, block, index_at = [], [], 0
        files, base = _opened(root)
        archive = index = None

        def close_block() -> None:
            nonlocal index_at
            raw = _gzip("\n".join(json.dumps(line) for line in block).encode())
            index.write(raw)
            directory.append([*block[0][:2], index_at, len(raw)])
            index_at += len(raw)
            block.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    files.create_dir(base, recursive=True)
                    archive = files.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                    index = files.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                    first = (row["key"], row["page_id"])
                payload = zlib.decompress(row["html"]) if row["html"] else b""
                raw = _gzip(record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["refers_url"]))
                archive.write(raw)
                block.append([row["key"], row["page_id"], at, len(raw)])
                at, n = at + len(raw), n + 1
                if len(block) == BLOCK_CAPTURES:
                    close_block()
        if archive is not None:
            if block:
                close_block()
            archive.close()
            index.close()
            with files.open_output_stream(f"{base}/{name}.dir.gz", compression=None) as out:
                out.write(_gzip(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_pydict({"part": [name], "first_key": [first[0]], "first_page": pa.array([first[1]], pa.int64()), "captures": [n], "bytes": [at]})

    made = rows.mapInArrow(write, "part string, first_key string, first_page long, captures long, bytes long")
    return Archive(root, cut(made, "warc-parts"))


class _Part:
    """An open archive part: its directory in memory, one block and one stretch of the archive at a time."""

    def __init__(self, root: str, name: str):
        files, base = _opened(root)
        self._index = files.open_input_file(f"{base}/{name}.cdx.gz")
        self._archive = files.open_input_file(f"{base}/{name}.warc.gz")
        with files.open_input_file(f"{base}/{name}.dir.gz") as f:
            self._directory = json.loads(zlib.decompress(f.read(), 31))
        self._firsts = [_place(*d[:2]) for d in self._directory]
        self._block_no, self._block = -1, []
        self._from, self._stretch = 0, b""
        self._size = self._archive.size()

    def close(self) -> None:
        self._index.close()
        self._archive.close()

    def _load(self, number: int) -> None:
        if number != self._block_no:
            _, _, at, size = self._directory[number]
            lines = zlib.decompress(self._index.read_at(size, at), 31).decode().split("\n")
            self._block = [json.loads(line) for line in lines]
            self._places = [_place(*c[:2]) for c in self._block]
            self._block_no = number

    def _raw(self, at: int, size: int) -> bytes:
        if not self._from <= at <= at + size <= self._from + len(self._stretch):
            self._from = at
            self._stretch = self._archive.read_at(min(max(size, READ_AHEAD), self._size - at), at)
        return zlib.decompress(self._stretch[at - self._from : at - self._from + size], 31)

    def find(self, key: str, page_id: int | None = None, any_page: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records of a capture, or of every capture of a key."""
        want = (key.encode(), False, -(2**63)) if any_page else _place(key, page_id)
        number = max(0, bisect.bisect_left(self._firsts, want) - 1)
        while number < len(self._firsts) and (self._firsts[number] <= want or any_page and self._firsts[number][0] == want[0]):
            self._load(number)
            for i in range(bisect.bisect_left(self._places, want), len(self._places)):
                if self._places[i] != want and not (any_page and self._places[i][0] == want[0]):
                    return
                yield parse(self._raw(*self._block[i][2:]))
            number += 1


def _tops(archive: Archive) -> tuple[list[tuple], list[str]]:
    rows = archive.parts.select("first_key", "first_page", "part").collect()  # one row per archive file
    rows = sorted((_place(r.first_key, r.first_page), r.part) for r in rows)
    return [r[0] for r in rows], [r[1] for r in rows]


def lookup(archive: Archive, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and payload of every capture of one URL, by two binary searches and range reads."""
    spark = archive.parts.sparkSession
    key = spark.createDataFrame([(url,)], "url string").select(url_key()).first()[0]
    firsts, names = _tops(archive)
    at = max(0, bisect.bisect_left(firsts, (key.encode(), False, -(2**63))) - 1)
    found = []
    while at < len(names) and (firsts[at][0] <= key.encode()):
        part = _Part(archive.root, names[at])
        found += part.find(key, any_page=True)
        part.close()
        at += 1
    return found


def read_captures(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of ``captures(key, page_id)``: page_id, record_type, payload_bytes, payload_digest, refers_to.

    Sizes and digests are taken from the payloads read; a revisit has its digest header and no size yet.
    """
    firsts, names = _tops(archive)
    root = archive.root

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("page_id").to_pylist()
            part = [max(0, bisect.bisect_right(firsts, _place(k, i)) - 1) for k, i in zip(keys, ids)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "key": batch.column("key"), "page_id": batch.column("page_id")})

    asked = captures.select("key", "page_id").mapInArrow(locate, "part int, key string, page_id long")
    asked = asked.repartition("part").sortWithinPartitions("part", "key", "page_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, None
        for batch in batches:
            made: dict[str, list] = {c: [] for c in ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")}
            for want in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "page_id"))):
                if want == last:  # repeated captures come together
                    continue
                if last is None or want[0] != last[0]:
                    if part is not None:
                        part.close()
                    part = _Part(root, names[want[0]])
                last = want
                for headers, payload in part.find(want[1], want[2]):
                    told = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != told:
                        raise ValueError(f"payload of page {want[2]} doesn't have its digest")
                    made["page_id"].append(want[2])
                    made["record_type"].append(headers["WARC-Type"])
                    made["payload_bytes"].append(None if revisit else len(payload))
                    made["payload_digest"].append(told)
                    made["refers_to"].append(int(headers["X-Refers-To-Page"]) if revisit else None)
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) for c, v in made.items()})

    return asked.mapInArrow(read, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archived_pages(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Write all pages, read every capture back through the index, and resolve revisits."""
    archive = write_archive(pages, parts)
    captures = pages.select(url_key().alias("key"), F.col("page_id").cast("long").alias("page_id"))
    read = cut(read_captures(archive, captures), "warc-read")
    whole = read.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("whole"))
    once = read.where("record_type = 'revisit'").join(whole, "payload_digest")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    once = once.withColumn("payload_bytes", F.col("whole")).select(*columns)
    return read.where("record_type = 'response'").select(*columns).unionByName(once)


CHECK_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest AND p.payload_bytes >= {MIN_REVISIT_BYTES}
"""
