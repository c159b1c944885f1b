"""A hierarchical navigable small-world graph over one shard of unit vectors, in numpy.

Neighbours are flat int32 arrays, one row per node and layer, -1 where unused. Nodes enter in batches:
a batch searches the graph built so far in one vectorised beam, meets its own members
directly, keeps diverse neighbours, and links back; full rows are chosen anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE, DEGREE_0 = 12, 24
BUILD_BEAM, BATCH, START = 48, 512, 64
_EXPAND = 4


@dataclass
class Layer:
    nodes: np.ndarray  # the layer's nodes, in the order in which they entered
    links: np.ndarray  # nodes of the shard x degree; rows of other nodes are not kept: see rows
    rows: np.ndarray  # row of each node of the shard in links, -1 if it isn't in this layer


def beam_search(x: np.ndarray, layer: Layer, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first (-1 where fewer), and their cosines."""
    n, q = len(x), len(queries)
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    every = np.arange(q)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", queries, x[entry]), False
    seen[every, entry] = True
    active = every
    while len(active):
        pick = np.argsort(np.where(done[active], np.inf, -sims[active]), axis=1, kind="stable")[:, :_EXPAND]
        open_ = ~np.take_along_axis(done[active], pick, 1)
        go = open_.any(axis=1)
        active, pick, open_ = active[go], pick[go], open_[go]
        if not len(active):
            break
        node = np.where(open_, np.take_along_axis(ids[active], pick, 1), -1)
        flags = done[active]
        np.put_along_axis(flags, pick, True, 1)
        done[active] = flags
        near = layer.links[layer.rows[np.maximum(node, 0)]]
        near = np.where(node[:, :, None] >= 0, near, -1).reshape(len(active), -1)
        near = np.where(seen[active[:, None], np.maximum(near, 0)], -1, near)
        order = np.sort(near, axis=1)  # the same node from two sides counts once
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        near = order
        at, col = np.nonzero(near >= 0)
        seen[active[at], near[at, col]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[at, col] = np.einsum("ed,ed->e", queries[active[at]], x[near[at, col]])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], found], axis=1)
        all_done = np.concatenate([done[active], near < 0], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1) | (ids[active] < 0)
    return ids, sims


def _chosen(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """``m`` of each row's candidates: near ones that are nearer to the node than to one chosen before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    b, c = cand.shape
    out = np.full((b, m), -1, np.int32)
    vectors = np.zeros((b, m, x.shape[1]), np.float32)
    count, taken = np.zeros(b, np.int64), np.zeros((b, c), bool)
    for j in range(c):
        rows = np.flatnonzero((cand[:, j] >= 0) & (count < m))
        if not len(rows):
            continue
        v = x[cand[rows, j]]
        among = np.einsum("bd,bmd->bm", v, vectors[rows])
        among[np.arange(m)[None, :] >= count[rows, None]] = -np.inf
        rows_ok = sims[rows, j] > among.max(axis=1)
        v, rows = v[rows_ok], rows[rows_ok]
        out[rows, count[rows]], vectors[rows, count[rows]], taken[rows, j] = cand[rows, j], v, True
        count[rows] += 1
    for j in range(c):
        rows = np.flatnonzero((cand[:, j] >= 0) & ~taken[:, j] & (count < m))
        out[rows, count[rows]] = cand[rows, j]
        count[rows] += 1
    return out


def _linked_back(x: np.ndarray, layer: Layer, new: np.ndarray, chosen: np.ndarray) -> None:
    degree = layer.links.shape[1]
    at, col = np.nonzero(chosen >= 0)
    target, source = chosen[at, col], new[at]
    sim = np.einsum("ed,ed->e", x[target], x[source])
    order = np.lexsort((-sim, target))
    target, source = target[order], source[order]
    hit, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    keep = place < degree  # the nearest of them: a row has no more places
    more = np.full((len(hit), degree), -1, np.int32)
    more[np.repeat(np.arange(len(hit)), count)[keep], place[keep]] = source[keep]
    old = layer.links[layer.rows[hit]]
    cand = np.concatenate([old, more], axis=1)
    again = np.sort(cand, axis=1)
    again[:, 1:][again[:, 1:] == again[:, :-1]] = -1
    sims = np.where(again >= 0, np.einsum("bd,bcd->bc", x[hit], x[np.maximum(again, 0)]), -np.inf)
    layer.links[layer.rows[hit]] = _chosen(x, again, sims, degree)


def build(x: np.ndarray, seed: int) -> list[Layer]:
    """Layers from the top to the bottom over unit vectors ``x``."""
    n = len(x)
    drawn = np.random.Generator(np.random.PCG64(seed)).random(n)
    level = np.floor(-np.log(np.maximum(drawn, 1e-12)) / np.log(DEGREE)).astype(np.int64)
    layers: list[Layer] = []
    for height in range(int(level.max()), -1, -1):
        nodes = np.flatnonzero(level >= height)
        nodes = nodes[np.argsort(-level[nodes], kind="stable")].astype(np.int32)
        degree = DEGREE_0 if height == 0 else DEGREE
        rows = np.full(n, -1, np.int32)
        rows[nodes] = np.arange(len(nodes))
        layer = Layer(nodes, np.full((len(nodes), degree), -1, np.int32), rows)
        done = 0
        while done < len(nodes):
            batch = nodes[done : done + min(max(done, START), BATCH)]
            own = np.einsum("ad,bd->ab", x[batch], x[batch])
            np.fill_diagonal(own, -np.inf)
            cand = np.broadcast_to(batch, own.shape)
            top = np.argsort(-own, axis=1, kind="stable")[:, :BUILD_BEAM]
            cand, own = np.take_along_axis(cand, top, 1), np.take_along_axis(own, top, 1)
            if done:
                entry = descend(x, layers, x[batch])
                entry = np.where((rows[entry] >= 0) & (rows[entry] < done), entry, nodes[0])
                ids, sims = beam_search(x, layer, x[batch], entry, BUILD_BEAM)
                cand, own = np.concatenate([ids, cand], axis=1), np.concatenate([sims, own], axis=1)
            cand = np.where(np.isneginf(own), -1, cand)
            chosen = _chosen(x, cand, own, degree)
            layer.links[rows[batch]] = chosen
            _linked_back(x, layer, batch, chosen)
            done += len(batch)
        layers.append(layer)
    return layers


def descend(x: np.ndarray, layers: list[Layer], queries: np.ndarray) -> np.ndarray:
    """The nearest node found in the given layers, from the top down."""
    entry = np.full(len(queries), layers[0].nodes[0] if layers else 0, np.int32)
    for layer in layers:
        entry = beam_search(x, layer, queries, entry, 4)[0][:, 0]
    return entry


def search(x: np.ndarray, layers: list[Layer], queries: np.ndarray, beam: int) -> np.ndarray:
    """Ids of the ``beam`` nearest nodes found for each query (-1 where fewer)."""
    return beam_search(x, layers[-1], queries, descend(x, layers[:-1], queries), beam)[0]
