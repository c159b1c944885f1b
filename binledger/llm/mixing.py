"""Mixing sources to target weights.

Every document gets a hash-random key; within its source, documents stand in key order (range-sorted),
and a distributed prefix sum of word counts says where each begins. A source's budget is cut
at its exact word: whole passes over the source (epochs) first, then documents in order, the last
one in part. Keys depend on doc_id alone, so reruns agree.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating. All words are
shared by weight; a source stops at ``MOST_EPOCHS`` times its size and what is over goes to the others by weight
until none is above. That is ``min(3 * size, level * weight)`` for one level, found from
the sources' totals in the order of size to weight.

Defined results: a null text has size 0 and is never taken, nor is any text without words; a source
without words has target 0; repeated rows are separate rows; rows without doc_id share one key and
stand in the order of their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binledger.llm.ranges import hex_key, per_group, running_totals
from binledger.llm.words import find_words, map_slices
from binledger.session import cut

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SALT = "mix"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``_group, source_size, target`` of every source of ``sized(_group, size)``; one row per source."""
    totals = sized.groupBy("_group").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("_group")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    # one row per source from here on: sources in the order in which they reach their cap
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "_group")
    exact = "decimal(38,0)"
    table = (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * MOST_EPOCHS)
        .withColumn("capped", F.sum(F.col("cap")).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.col("capped"))
        .withColumn("level", F.when(
            F.col("left").cast(exact) * F.col("weight").cast("decimal(9,0)") <= F.col("cap").cast(exact) * F.col("open").cast("decimal(12,0)"),
            F.struct(F.row_number().over(by_cap).alias("at"), "left", "open"),
        ))
        .withColumn("level", F.min("level").over(Window.partitionBy()))
        .withColumn("at", F.row_number().over(by_cap))
    )
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.open").cast("double")
    target = F.when(F.col("at") >= F.col("level.at"), share).otherwise(F.col("cap").cast("double"))
    return table.select("_group", "source_size", target.alias("target"))


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``documents(doc_id, source, size, ...)`` with source_size, target and taken (words, repeats counted)."""
    keyed = documents.withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    keyed = keyed.withColumn("_key", hex_key("doc_id", salt=SALT))
    goal = per_group(targets(keyed.select("_group", "size"), weights), "targets")
    placed = running_totals(keyed, "_group", "_key", "size", ["doc_id", "size"], "_before")
    budget = F.floor("target")
    total = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / total)
    taken = epochs * F.col("size") + F.least(F.greatest(budget - epochs * total - F.col("_before"), F.lit(0)), F.col("size"))
    return placed.join(goal, "_group").withColumn("taken", taken.cast("long")).drop("_group", "_key", "_before")


def mixed_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words().alias("size"))
    return mix(cut(sized, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last copy cut at the budget's last word.

    Columns are those of ``documents``; ``n_chars``, where present, follows a cut text.
    """
    whole = documents.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), F.struct("*").alias("row"))
    times = F.expr("sequence(1L, (taken + size - 1) div size)")
    copies = (
        mix(whole).where("taken > 0")
        .withColumn("copy", F.explode(times))
        .select("row", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).alias("words"), "size")
    )
    plain = copies.where("words = size").select("row.*")
    short = copies.where("words < size").select("row.text", "row", "words")

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        w = find_words(piece.column("text"), hashed=False)
        made = []
        for i, n in enumerate(piece.column("words").to_pylist()):
            made.append(w.data[w.offsets[i] : w.ends[w.first[i] + n - 1]].tobytes().decode())
        return pa.RecordBatch.from_pydict({"row": piece.column("row"), "cut": pa.array(made)})

    schema = short.select("row", F.col("text").alias("cut")).schema
    short = map_slices(short, "text", work, schema)
    short = short.withColumn("row", F.col("row").withField("text", F.col("cut")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        short = short.withColumn("row", F.col("row").withField("n_chars", F.length("cut").cast(kind)))
    return plain.unionByName(short.select("row.*"))


CHECK_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
tried AS (  -- the level if exactly the sources with a smaller cap per weight than this one are capped
  SELECT a.source, (SELECT sum(total) FROM w)
         - coalesce((SELECT sum(3 * b.total) FROM w b WHERE b.total::DOUBLE / b.weight < a.total::DOUBLE / a.weight), 0) AS rest,
         (SELECT sum(b.weight) FROM w b WHERE b.total::DOUBLE / b.weight >= a.total::DOUBLE / a.weight) AS open,
         a.total, a.weight
  FROM w a),
best AS (SELECT rest, open FROM tried WHERE rest * weight <= 3 * total * open ORDER BY total::DOUBLE / weight LIMIT 1),
goal AS (
  SELECT w.source, w.total,
         CASE WHEN best.rest * w.weight <= 3 * w.total * best.open
              THEN (best.rest * w.weight)::DOUBLE / best.open::DOUBLE ELSE (3 * w.total)::DOUBLE END AS target
  FROM w CROSS JOIN best),
placed AS (
  SELECT s.doc_id, s.size, g.total, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, total AS source_size, target,
       (budget // greatest(total, 1) * size
        + least(greatest(budget % greatest(total, 1) - before, 0), size))::BIGINT AS taken
FROM placed
"""
