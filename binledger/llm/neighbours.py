"""Approximate nearest neighbours: one small-world graph per shard, shard results merged.

Equal vectors form one node that carries its ``K + 1`` smallest ids, all that any answer can need. Nodes are
dealt to shards of about ``SHARD_ROWS`` by hash; each shard's graph is built in one task of bounded size and
written to the shared folder as flat arrays. Queries are dealt in blocks of bounded size: every
(shard, block) pair is one task's work, and a window keeps the best over shards.

The graph decides which nodes are looked at; scores are cosines in double precision of the original vectors, and
ties go to the smaller vec_id.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor
do rows without vec_id; vectors of different lengths are never compared; repeated rows count once; if a vec_id has
several vectors, each is a candidate, each is a query of that id, and none answers that id.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binledger.llm import hnsw
from binledger.llm.ranges import per_group
from binledger.session import cut

K = 5
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
BEAM = 96
_STEP = 512


def usable(embeddings: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    return rows.withColumn("dim", F.size("vector"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(lists: pa.ChunkedArray, n: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _built(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The graph of one shard as one row of flat arrays."""
    n = table.num_rows
    vectors = _matrix(table["vector"], n)
    order = np.lexsort(vectors.T[::-1])  # the same graph whatever order the rows came in
    ids = np.full((n, K + 1), -1, np.int64)
    for i, own in enumerate(table["ids"].to_pylist()):
        ids[i, : len(own)] = own
    vectors, ids = vectors[order], ids[order]
    layers = hnsw.build(_unit(vectors).astype(np.float32), seed=17)
    graph = [(a.nodes.tobytes(), a.links.tobytes(), a.links.shape[1]) for a in layers]
    return pa.table({
        "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()),
        "vectors": pa.array([vectors.tobytes()]), "ids": pa.array([ids.tobytes()]), "graph": pa.array([pickle.dumps(graph)]),
    })


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray, list[hnsw.Layer]]:
    ids = np.frombuffer(row["ids"], np.int64).reshape(-1, K + 1)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    layers = []
    for nodes, links, degree in pickle.loads(row["graph"]):
        nodes, rows = np.frombuffer(nodes, np.int32), np.full(len(ids), -1, np.int32)
        rows[nodes] = np.arange(len(nodes))
        layers.append(hnsw.Layer(nodes, np.frombuffer(links, np.int32).reshape(-1, degree), rows))
    return vectors, ids, layers


def _searched(key: tuple[pa.Scalar, ...], shard: pa.Table, queries: pa.Table) -> pa.Table:
    """The best of one shard for one block of queries."""
    found = {"query_id": [], "query_no": [], "vec_id": [], "score": []}
    if shard.num_rows and queries.num_rows:
        vectors, ids, layers = _loaded(shard.to_pylist()[0])
        x = _unit(vectors)
        x32 = x.astype(np.float32)
        q = _unit(_matrix(queries["vector"], queries.num_rows))
        names, numbers = queries["query_id"].to_numpy(), queries["query_no"].to_numpy()
        for lo in range(0, len(q), _STEP):
            own = q[lo : lo + _STEP]
            near = hnsw.search(x32, layers, own.astype(np.float32), BEAM)
            score = np.einsum("qd,qnd->qn", own, x[np.maximum(near, 0)])
            score = np.where(near >= 0, np.clip(score, -1, 1), -np.inf)
            for i in range(len(own)):
                member = ids[np.maximum(near[i], 0)]
                good = (member >= 0) & (near[i] >= 0)[:, None] & (member != names[lo + i])
                flat, value = member[good], np.broadcast_to(score[i][:, None], member.shape)[good]
                best = np.lexsort((flat, -value))[:K]
                found["query_id"].append(np.full(len(best), names[lo + i]))
                found["query_no"].append(np.full(len(best), numbers[lo + i]))
                found["vec_id"].append(flat[best])
                found["score"].append(value[best])
    whole = {c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64) for c, v in found.items()}
    return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in whole.items()})


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """The graphs of all shards, written, and ``(dim, shards)``."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    nodes = rows.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= K + 1)
    nodes = cut(nodes.groupBy("dim", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-nodes")
    shards = per_group(nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("long").alias("shards")), "ann-shards")
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))
    schema = "dim int, shard long, vectors binary, ids binary, graph binary"
    return cut(dealt.groupBy("dim", "shard").applyInArrow(_built, schema), "ann-index"), shards


def nearest(embeddings: DataFrame, is_query, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``K`` nearest found for every row with ``is_query``."""
    rows = usable(embeddings)
    graphs, shards = index(rows, shard_rows)
    queries = cut(rows.where(is_query).distinct().withColumnRenamed("vec_id", "query_id"), "ann-queries")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    queries = queries.withColumn("query_no", F.xxhash64("vector")).withColumn("block", F.pmod("query_no", F.lit(blocks)))
    asked = queries.join(shards, "dim").withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)"))).drop("shards")
    held = graphs.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    found = (
        held.groupBy("dim", "shard", "block")
        .cogroup(asked.groupBy("dim", "shard", "block"))
        .applyInArrow(_searched, "query_id long, query_no long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
