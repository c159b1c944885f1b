"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

* **Signature.** Each distinct shingle of a document walks its own random permutation of the
  signature's places: its j-th step lands on another place with value j plus a fraction.
  A place keeps the least value. Ranks of one shingle are thus correlated, which lowers the
  estimate's variance, and a document stops once every place is filled, as no later step
  can be smaller. All documents of a slice take step j together.
* **Exact copies first.** Documents with equal shingle sets form a class (pre-aggregated);
  only class representatives are banded, so a group of copies costs one row.
* **Banding.** ``BANDS`` x ``ROWS`` values: a pair at similarity 0.8 shares no band with
  probability (1 - 0.8^6)^40 = 5e-6, more similar pairs far less.
* **Verification** on full shingle sets, in three rounds that test every candidate pair
  whose ends are not yet in one component, without listing all pairs of a bucket: each
  document with its most frequent bucket head; with its other heads; and pairs across
  different components of a bucket. Within a component further links change nothing. In the
  last two rounds bitmaps of the shingles bound what a pair can share; pairs that can't reach the
  threshold are left out, which is exact.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; a
row without doc_id is linked with nothing, has no component and is kept; rows that repeat
a doc_id count as one node; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.functions.components import connected_components
from binledger.llm.words import _PLACE, find_words, map_slices, mix, windows
from binledger.session import cut

BANDS, ROWS = 40, 6
PLACES = BANDS * ROWS
SIMILAR_PERCENT = 80
#: Bits of a document's bitmap of shingles.
BITS = 4096
#: More ids than this are not broadcast to filter texts, but joined by sorting.
BROADCAST_IDS = 1_000_000

_KEY_BITS, _ROW_BITS = np.uint64(54), np.uint64(10)
_SLICE_ROWS = 1 << 10
_DIRECT_FROM = 8
_UNFILLED = np.uint64(2**64 - 1)


def shingle_keys(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of up to 1024 texts: sorted ``row << 54 | shingle`` keys, and how many each has."""
    w = find_words(texts, lower=True)
    made, _, before = windows(w.hashes, w.first, k)
    keys = [made >> _ROW_BITS | np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(before)) << _KEY_BITS]
    for c in range(1, k):  # texts with fewer words: the whole sequence
        rows = np.flatnonzero(w.counts == c)
        total = np.zeros(len(rows), np.uint64)
        for i in range(c):
            total += w.hashes[w.first[rows] + i] * _PLACE[i]
        keys.append(mix(total + np.uint64(c)) >> _ROW_BITS | rows.astype(np.uint64) << _KEY_BITS)
    keys = np.sort(np.concatenate(keys))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.bincount((keys >> _KEY_BITS).astype(np.int64), minlength=len(texts))


def super_minhash(shingles: np.ndarray, own: np.ndarray, n_texts: int, places: int = PLACES) -> np.ndarray:
    """Signatures (texts x places) of shingle hashes; ``own`` is each shingle's text."""
    sig = np.full(n_texts * places, _UNFILLED, np.uint64)
    x, own = mix(shingles + np.uint64(0x632BE59BD9B4E019)), own.astype(np.int64)
    steps: list[np.ndarray] = []  # the place swapped at each step so far
    perm = None
    for j in range(places):
        if not len(x):
            break
        r = mix(x + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
        k = (j + (r & np.uint64(0xFFFFFFFF)) % np.uint64(places - j)).astype(np.int64)
        if j < _DIRECT_FROM:
            place = k.copy()
            for i in range(j - 1, -1, -1):
                place = np.where(place == steps[i], i, place)
            steps.append(k)
        else:
            if perm is None:
                perm = np.tile(np.arange(places, dtype=np.int16), (len(x), 1))
                every = np.arange(len(x))
                for i, s in enumerate(steps):
                    perm[every, s], perm[:, i] = perm[:, i].copy(), perm[every, s].copy()
            every = np.arange(len(x))
            place = perm[every, k].astype(np.int64)
            perm[every, k] = perm[:, j]
        np.minimum.at(sig, own * places + place, np.uint64(j) << np.uint64(32) | r >> np.uint64(32))
        filled = (sig.reshape(n_texts, places) != _UNFILLED).all(axis=1)
        if filled.any():
            stay = ~filled[own]
            x, own = x[stay], own[stay]
            steps = [s[stay] for s in steps] if perm is None else []
            perm = perm[stay] if perm is not None else None
    return sig.reshape(n_texts, places)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    total = np.zeros((len(sig), BANDS), np.uint64)
    for i in range(ROWS):
        total += mix(sig[:, i::ROWS] + np.uint64(i + 1)) * _PLACE[i]
    return mix(total + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the shingle set, and the bands' keys."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        parts = [_sign(piece.slice(i, _SLICE_ROWS), k) for i in range(0, piece.num_rows, _SLICE_ROWS)]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), "text", work, schema)


def _sign(piece: pa.RecordBatch, k: int) -> pa.RecordBatch:
    keys, counts = shingle_keys(piece.column("text"), k)
    own = (keys >> _KEY_BITS).astype(np.int64)
    shingles = keys << _ROW_BITS
    bands = _band_keys(super_minhash(shingles, own, piece.num_rows)).view(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    sets = []
    for salt in (np.uint64(1), np.uint64(0xA24BAED4963EE407)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles + salt))])
        sets.append(mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64)).view(np.int64))
    empty = counts == 0
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]).astype(np.int32)),
        pa.array(bands[~empty].ravel()),
    )
    return pa.RecordBatch.from_pydict({
        "doc_id": piece.column("doc_id"),
        "n_shingles": pa.array(counts.astype(np.int64)),
        "set_a": pa.array(sets[0], mask=empty),
        "set_b": pa.array(sets[1], mask=empty),
        "bands": lists,
    })


def _texts(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents with these ids."""
    ids = cut(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _bitmaps(ids: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """``u, bits, extra``: which of ``BITS`` bits a document's shingles hit, and how many shingles hit a bit again.

    Shared shingles hit shared bits, so two documents share at most as many shingles as
    bits, plus the smaller ``extra``: an exact bound that needs no texts.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for i in range(0, piece.num_rows, _SLICE_ROWS):
            part = piece.slice(i, _SLICE_ROWS)
            keys, counts = shingle_keys(part.column("text"), k)
            hit = np.zeros((part.num_rows, BITS), bool)
            hit[(keys >> _KEY_BITS).astype(np.int64), (keys >> np.uint64(40)).astype(np.int64) % BITS] = True
            bits = np.packbits(hit, axis=1).view(np.int64)
            parts.append(pa.RecordBatch.from_pydict({
                "u": part.column("doc_id"),
                "bits": pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits.ravel())),
                "extra": pa.array((counts - hit.sum(axis=1)).astype(np.int64)),
            }))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return cut(map_slices(_texts(ids, documents), "text", work, "u long, bits array<long>, extra long"), "bitmaps")


def _verified(pairs: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose full shingle sets are similar enough, as a written table."""
    pairs = cut(pairs.select("u", "v").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    texts = cut(_texts(ids, documents), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text")), "u")
    both = both.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("other")), "v")

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i in range(0, piece.num_rows, _SLICE_ROWS):
            part = piece.slice(i, _SLICE_ROWS)
            (a, n), (b, m) = (shingle_keys(part.column(c), k) for c in ("text", "other"))
            shared = np.intersect1d(a, b, assume_unique=True)
            shared = np.bincount((shared >> _KEY_BITS).astype(np.int64), minlength=part.num_rows)
            keep.append((100 * shared >= SIMILAR_PERCENT * (n + m - shared)) & (n > 0))
        return piece.select(["u", "v"]).filter(pa.array(np.concatenate(keep)))

    return cut(map_slices(both.select("u", "v", "text", "other"), "text", work, "u long, v long"), "links")


def _joined_to_roots(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``df`` with the component of ``column``, itself where it has no link yet."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return df.join(named, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows ``(bucket, u, ...)`` of buckets that hold more than one component, with ``u_root``."""
    placed = _joined_to_roots(members, roots, "u")
    several = placed.groupBy("bucket").agg(F.min("u_root").alias("a"), F.max("u_root").alias("z")).where("a < z")
    return cut(placed.join(several.select("bucket"), "bucket", "left_semi"), "mixed")


def _links(reps: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Components of the representatives ``(rep, n, bands)``: ``(node, root)``."""
    spread = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    heads = spread.groupBy("bucket").agg(
        F.min(F.struct("rep", "n")).alias("head"), F.max("rep").alias("last")
    ).where("head.rep < last")
    members = cut(
        spread.join(heads, "bucket").select("bucket", "rep", "n", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n")),
        "members",
    )

    def fits(a: str, b: str):
        return F.expr(f"100L * least({a}, {b}) >= {SIMILAR_PERCENT}L * greatest({a}, {b})")

    shared = members.where("rep <> head").where(fits("n", "head_n"))
    shared = shared.groupBy(F.col("rep").alias("u"), F.col("head").alias("v")).agg(F.count("*").alias("shared"))
    best = shared.groupBy("u").agg(F.max(F.struct("shared", (-F.col("v")).alias("v"))).alias("b"))
    tried = cut(best.select("u", (-F.col("b.v")).alias("v")), "best")
    roots = cut(connected_components(_verified(tried, documents, k)), "roots")

    # Only buckets with several components are left.
    open_ = _mixed(members.select("bucket", F.col("rep").alias("u"), "n"), roots)
    if open_.isEmpty():
        return roots
    bitmaps = _bitmaps(open_.select(F.col("u").alias("doc_id")).distinct(), documents, k)

    def pairs(left: DataFrame, right: DataFrame, test: str) -> DataFrame:
        """Pairs of one bucket, in two components, that ``test`` and the bound on shared shingles admit."""
        most = F.expr("aggregate(zip_with(bits, v_bits, (a, b) -> bit_count(a & b)), 0, (s, x) -> s + x) + least(extra, v_extra)")
        return (
            left.join(bitmaps, "u").join(right, "bucket")
            .where(f"u_root <> v_root AND {test}").where(fits("n", "v_n"))
            .where((100 + SIMILAR_PERCENT) * most >= SIMILAR_PERCENT * (F.col("n") + F.col("v_n")))
            .select("u", "v").distinct()
        )

    named = [F.col("u").alias("v"), F.col("u_root").alias("v_root"), F.col("n").alias("v_n")]
    marks = bitmaps.select(F.col("u").alias("v"), F.col("bits").alias("v_bits"), F.col("extra").alias("v_extra"))
    first = open_.groupBy("bucket").agg(F.min(F.struct(*named)).alias("h")).select("bucket", "h.*").join(marks, "v")
    rest = cut(pairs(open_, first, "u <> v").join(tried, ["u", "v"], "left_anti"), "rest")
    more = _verified(rest, documents, k)
    if not more.isEmpty():
        roots = cut(connected_components(_edges(roots).unionByName(more)), "roots")

    open_ = _mixed(open_.select("bucket", "u", "n"), roots)
    if open_.isEmpty():
        return roots
    other = open_.select("bucket", *named).join(marks, "v")
    across = pairs(open_, other, "u > v").join(tried.unionByName(rest), ["u", "v"], "left_anti")
    more = _verified(across, documents, k)
    if not more.isEmpty():
        roots = cut(connected_components(_edges(roots).unionByName(more)), "roots")
    return roots


def _edges(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def near_duplicates(documents: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, a row per row of ``documents``."""
    signed = cut(signatures(documents, k), "signatures")
    told = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(
        told.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep")), "classes"
    )
    first = told.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    first = first.dropDuplicates(["doc_id", "set_a", "set_b"])  # every text of a doc_id keeps its bands
    reps = first.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands")
    roots = _links(reps, documents, k)
    classes = _joined_to_roots(classes.select("set_a", "set_b", "rep"), roots, "rep")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep_root", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(classes.select("set_a", "set_b", "rep_root"), ["set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_first(documents: DataFrame, k: int = 5) -> DataFrame:
    """The documents of which no near-duplicate has a smaller doc_id, with all their columns.

    Rows that repeat one doc_id all stay or all go.
    """
    gone = near_duplicates(documents, k).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = cut(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return documents.join(gone, documents["doc_id"].cast("long") == gone["_gone"], "left_anti")


CHECK_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s
  FROM split),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared WHERE 100 * common >= 80 * (nx + ny - common)),
step AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS d, doc_id AS c FROM sets
  UNION
  SELECT step.y, reach.c FROM reach JOIN step ON step.x = reach.d WHERE reach.c < step.y)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM sets JOIN reach ON d = doc_id GROUP BY doc_id, s
"""
