"""Vector code compression: integer product codes, learned over a trie of distinct parts.

Components become integers floor(4096 * x), and every vector is cut into ``PARTS`` equal parts. The distinct
parts of each position, with their counts, are written once in lexicographic order: rows in that order
are the leaves of a trie over the components, depth first. A task walks its rows in blocks and keeps the path to the last
row: for a component that continues a prefix seen before, the distances of that prefix to all entries
are taken over, so each node of the trie adds one squared difference per entry, once. A leaf takes the
nearest entry and adds its components, times its count, to that entry's sums. Only sums per entry leave a task;
the driver holds nothing but the codebooks.

All arithmetic is on integers, so results don't depend on how rows are dealt.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; nor do vectors with
another number of components than the kept one with the smallest vec_id (which must be a positive multiple of ``PARTS``), nor
any with an integer beyond +-2^27, whose squared distances would not fit the result. Null vec_ids come
last in the choice of first entries, equal vec_ids by their components; repeated rows count as often as they stand;
with fewer than ``ENTRIES`` rows a codebook has as many entries as rows. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binledger.llm.ranges import per_group
from binledger.llm.words import bound_batches
from binledger.session import cut

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0
LARGEST = 1 << 27
BLOCK_ROWS = 4096

Books = np.ndarray  # PARTS x entries x components of a part


def integer_vectors(embeddings: DataFrame, *keep: str) -> DataFrame:
    """``vec_id``, the columns ``keep`` and ``v``, the integers of every vector that takes part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, vector.alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & (F.size("_x") > 0) & (F.size("_x") % PARTS == 0))
    return rows.where(F.forall("_x", _is_sound)).select(
        "vec_id", *keep, F.transform("_x", lambda x: F.floor(x * SCALE).cast("int")).alias("v")
    )


def _is_sound(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x * SCALE) <= LARGEST), F.lit(False))


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> tuple[int, Books] | None:
    """The number of components and the first codebooks: the parts of the smallest vec_ids."""
    least = vectors.agg(F.min(F.struct(F.isnull("vec_id"), "vec_id", F.size("v").alias("n")))["n"].alias("n")).first()["n"]
    if least is None:
        return None
    rows = vectors.where(F.size("v") == least).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    return least, np.array([r["v"] for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def distinct_parts(vectors: DataFrame, width: int) -> DataFrame:
    """``(pos, part, n)``: the distinct parts of every position with their counts, in trie order inside each file."""
    size = width // PARTS
    cut_up = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("v", i * size + 1, size))
    parts = vectors.select(F.posexplode(cut_up).alias("pos", "part"))
    return cut(parts.groupBy("pos", "part").agg(F.count("*").alias("n")).sortWithinPartitions("pos", "part"), "code-parts")


def walk(parts: np.ndarray, book: np.ndarray, block: int = BLOCK_ROWS) -> Iterator[tuple[int, int, np.ndarray]]:
    """Squared distances of sorted ``parts`` to all entries of ``book``, block by block.

    ``path[d]`` holds the distances over the first d + 1 components of the row visited last. A row is a
    new node at depth d if it differs from the row before in a component up to d.
    """
    width = parts.shape[1]
    path = np.zeros((width, len(book)), np.int64)
    for lo in range(0, len(parts), block):
        rows = parts[lo : lo + block]
        differs = np.ones(rows.shape, bool)
        differs[1:] = rows[1:] != rows[:-1]
        if lo:
            differs[0] = rows[0] != parts[lo - 1]
        fresh = np.logical_or.accumulate(differs, axis=1)
        node, held = np.zeros(len(rows), np.int64), np.zeros((1, len(book)), np.int64)
        for d in range(width):
            new = fresh[:, d]
            made = held[node[new]] + (rows[new, d, None] - book[None, :, d]) ** 2
            if not new[0]:
                made = np.concatenate([path[d][None], made])
            node = np.cumsum(new) - int(new[0])
            held, path[d] = made, made[-1]
        yield lo, lo + len(rows), held[node]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def next_books(parts: DataFrame, books: Books) -> Books:
    """Every entry replaced by the floor of the mean of the parts nearest to it; unused entries stay."""
    _, entries, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            pos, n = batch.column("pos").to_numpy(), batch.column("n").to_numpy()
            values = _matrix(batch.column("part"), size)
            for p in np.unique(pos).tolist():
                own = pos == p
                mine, weight = values[own], n[own]
                for lo, hi, distances in walk(mine, books[p]):
                    nearest = distances.argmin(axis=1)
                    np.add.at(count[p], nearest, weight[lo:hi])
                    np.add.at(total[p], nearest, mine[lo:hi] * weight[lo:hi, None])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_pydict({
                "pos": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(count[p, e]),
                "totals": pa.array(list(total[p, e]), pa.list_(pa.int64())),
            })

    found = parts.mapInArrow(sums, "pos int, entry int, n long, totals array<long>")
    exact = [F.sum(F.col("totals")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(size)]
    made = books.copy()
    for row in found.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *exact).collect():  # PARTS x ENTRIES rows
        made[row["pos"], row["entry"]] = [int(row[f"t{i}"]) // row["n"] for i in range(size)]
    return made


def learn(vectors: DataFrame, width: int, books: Books, rounds: int = ROUNDS) -> Books:
    parts = distinct_parts(vectors, width)
    for _ in range(rounds):
        books = next_books(parts, books)
    return books


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """``vectors`` with ``code`` (two hex digits a part) in place of ``v``, and ``error``, the summed squared distances."""
    parts, _, size = books.shape
    kept = [c for c in vectors.columns if c != "v"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column("v"), parts * size).reshape(-1, parts, size)
            nearest, error = np.zeros((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
            for p in range(parts):
                leaves, of_row = np.unique(values[:, p], axis=0, return_inverse=True)
                best = np.zeros((len(leaves), 2), np.int64)
                for lo, hi, distances in walk(leaves, books[p]):
                    best[lo:hi, 0], best[lo:hi, 1] = distances.argmin(axis=1), distances.min(axis=1)
                nearest[:, p] = best[of_row.ravel(), 0]
                error += best[of_row.ravel(), 1]
            codes = pa.array([row.tobytes().hex() for row in nearest])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), codes, pa.array(error)], [*kept, "code", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "v")
    return vectors.mapInArrow(coded, f"{fields}, code string, error long")


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """``codes`` with ``v``, the integers that a code stands for."""
    entries = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in book)) for book in books.tolist()))
    index = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return codes.withColumn("v", F.flatten(F.transform(index, lambda i, p: F.get(F.get(entries, p), i))))


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code and error of every vector that takes part, the error of its label, and the codebooks' digest."""
    bound_batches(embeddings.sparkSession)
    vectors = integer_vectors(embeddings, "label")
    first = first_entries(vectors)
    if first is None:
        return vectors.select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
            F.lit(digest(np.zeros((PARTS, 0, 1), np.int64))).alias("codebooks_sha256"),
        )
    width, books = first
    vectors = vectors.where(F.size("v") == width)
    books = learn(vectors, width, books, rounds)
    coded = cut(encode(vectors, books), "codes")
    exact = F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS long)")
    per_label = coded.groupBy(F.col("label").alias("_label")).agg(exact.alias("label_error"))
    return (
        coded.join(per_group(per_label, "code-labels"), F.col("label").eqNullSafe(F.col("_label")))
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )


def _check_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: one assignment and one mean per round, over the distinct parts."""
    distance = "list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT x.pos, x.part, x.n, min({distance} * 16 + b.entry) % 16 AS entry
  FROM parts x JOIN book{r} b ON x.pos = b.pos GROUP BY ALL),
mean{r} AS MATERIALIZED (
  SELECT pos, entry, i, sum(n * part[i])::HUGEINT AS s, sum(n)::HUGEINT AS c
  FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM near{r}) GROUP BY ALL),
list{r} AS MATERIALIZED (
  SELECT pos, entry, list(((s - (s % c + c) % c) // c)::BIGINT ORDER BY i) AS part FROM mean{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(l.part, b.part) AS part
  FROM book{r} b LEFT JOIN list{r} l ON b.pos = l.pos AND b.entry = l.entry)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(4096.0::DOUBLE * y::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)),
cut_up AS MATERIALIZED (
  SELECT vec_id, label, pos, v[pos * (len(v) // 8) + 1 : (pos + 1) * (len(v) // 8)] AS part
  FROM kept, (SELECT unnest(range(8)) AS pos)),
parts AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM cut_up GROUP BY ALL),
book0 AS MATERIALIZED (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part
  FROM cut_up WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),{",".join(steps)},
last AS MATERIALIZED (
  SELECT x.vec_id, x.label, x.pos, min({distance} * 16 + b.entry) AS found
  FROM cut_up x JOIN book{rounds} b ON x.pos = b.pos GROUP BY ALL),
coded AS MATERIALIZED (
  SELECT vec_id, label, string_agg('0' || substr('0123456789abcdef', (found % 16)::INT + 1, 1), '' ORDER BY pos) AS code,
         sum((found - found % 16) // 16)::BIGINT AS error
  FROM last GROUP BY ALL),
labels_ AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY ALL),
digest AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT c.vec_id, c.code, c.error, l.label_error, d.codebooks_sha256
FROM coded c JOIN labels_ l ON c.label IS NOT DISTINCT FROM l.label, digest d"""


CHECK_SQL = _check_sql()
