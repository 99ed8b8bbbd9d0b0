"""Layered navigable graphs: approximate nearest neighbours by a walk.

Rows are dealt out to graphs of bounded size, each built and stored by one task. A node's top layer is drawn by a
keyed hash of its id. As if rows came one by one in the order of that hash, a
node is linked to the nearest of those before it on each of its layers, diverse ones first, and
they back to it; so early nodes carry the long links. A search goes down the layers to the
nearest node and then walks the lowest one with a beam. All graphs are searched
and their finds merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import VectorIndex
from .knn import squared_distances


def drawn_levels(ids: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's top layer, one in ``m`` reaching the next, and its place in the order of insertion; by a keyed hash of the id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    u = (h >> np.uint64(11)).astype(np.float64) / 2**53
    levels = np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(m)).astype(np.int64)
    order = np.lexsort((np.arange(len(ids)), h * np.uint64(0xD6E8FEB86659FD93)))
    return levels, order


def diverse(x: np.ndarray, candidates: np.ndarray, d: np.ndarray, most: int) -> list[np.ndarray]:
    """Links of each node among its candidates (ascending by distance ``d``; -1: none): those that are nearer to it than to any link chosen before."""
    known = candidates >= 0
    near = x[np.where(known, candidates, 0)]
    norms = (near**2).sum(2)
    apart = norms[:, :, None] + norms[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    kept = np.zeros(candidates.shape, bool)
    for j in range(candidates.shape[1]):
        kept[:, j] = known[:, j] & (kept.sum(1) < most) & ((apart[:, j, :] > d[:, j, None]) | ~kept).all(1)
    # Places that are left are filled with the nearest of the others.
    rest = known & ~kept
    kept |= rest & (np.cumsum(rest, 1) <= (most - kept.sum(1))[:, None])
    return [c[k] for c, k in zip(candidates, kept)]


def _layer(x: np.ndarray, m: int, wide: int, chunk: int = 256) -> np.ndarray:
    """Links of one layer whose nodes are the rows of ``x`` in the order of insertion: up to ``m`` for each, -1 where there are fewer."""
    n = len(x)
    links: list[list[int]] = [[] for _ in range(n)]
    for at in range(1, n, chunk):
        to = min(at + chunk, n)
        d = squared_distances(x[at:to], x[:to])
        d[np.arange(to)[None, :] >= np.arange(at, to)[:, None]] = np.inf  # those before it only
        take = min(wide, to - 1)
        near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < to else np.tile(np.arange(to), (to - at, 1))
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        dist = np.take_along_axis(d, near, 1)
        for i, chosen in enumerate(diverse(x, np.where(np.isfinite(dist), near, -1), dist, max(m // 2, 1))):
            links[at + i] += chosen.tolist()
            for j in chosen.tolist():
                links[j].append(at + i)
    out = np.full((n, m), -1, np.int32)
    over = [i for i in range(n) if len(links[i]) > m]
    for i in range(n):
        if len(links[i]) <= m:
            out[i, : len(links[i])] = links[i]
    for at in range(0, len(over), 64):
        some = over[at : at + 64]
        width = min(max(len(links[i]) for i in some), 4 * m)
        cand, dist = np.full((len(some), width), -1, np.int64), np.full((len(some), width), np.inf)
        for r, i in enumerate(some):
            ids = np.array(links[i])
            d = ((x[ids] - x[i]) ** 2).sum(1)
            near = np.argsort(d, kind="stable")[:width]
            cand[r, : len(near)], dist[r, : len(near)] = ids[near], d[near]
        for i, chosen in zip(some, diverse(x, cand, dist, m)):
            out[i, : len(chosen)] = chosen
    return out


def build(ids: np.ndarray, x: np.ndarray, m: int, lowest: int, wide: int, seed: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(order, layers): layers from the lowest, each its nodes (places in the order of insertion) and their links (places in the layer)."""
    levels, order = drawn_levels(ids, m, seed)
    levels, y = levels[order], x[order]
    layers = []
    for level in range(int(levels.max(initial=0)) + 1):
        nodes = np.flatnonzero(levels >= level)
        layers.append((nodes, _layer(y[nodes], lowest if level == 0 else m, wide)))
    return order, layers


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and squared distances of each query's beam, nearest first, and how many distances were measured; all queries step together.

    A query's step opens the nearest node of its beam that isn't open yet, and puts those linked to it in; it ends when all are open. It passes by its node of ``without``.
    """
    n, rows = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    nodes, d, opened = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), np.inf), np.ones((len(q), beam), bool)
    nodes[:, 0], opened[:, 0] = starts, False
    d[:, 0] = ((q - x[starts]) ** 2).sum(1)
    seen[rows, starts] = True
    if without is not None:
        seen[rows, without] = True
    measured = np.ones(len(q), np.int64)
    going = rows
    while len(going):
        at = np.where(opened[going], np.inf, d[going]).argmin(1)
        opened[going, at] = True
        near = links[nodes[going, at]]
        fresh = (near >= 0) & ~seen[going[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        who, node = going[r], near[r, c]
        seen[who, node] = True
        measured += np.bincount(who, minlength=len(q))
        new = np.full(near.shape, np.inf)
        new[r, c] = ((q[who] - x[node]) ** 2).sum(1)
        all_d = np.concatenate([d[going], new], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        d[going] = np.take_along_axis(all_d, best, 1)
        nodes[going] = np.take_along_axis(np.concatenate([nodes[going], np.where(fresh, near, -1)], 1), best, 1)
        opened[going] = np.take_along_axis(np.concatenate([opened[going], ~fresh], 1), best, 1)
        going = going[~opened[going].all(1)]
    return nodes, d, measured


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``walk``, down through the layers; ``x`` in the order of insertion."""
    starts, measured = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)  # a place in the layer
    for level in range(len(layers) - 1, 0, -1):
        nodes, links = layers[level]
        found, _, n = walk(x[nodes], links, q, starts, 1)
        starts = np.searchsorted(layers[level - 1][0], nodes[found[:, 0]])
        measured += n
    found, d, n = walk(x, layers[0][1], q, starts, beam, without)
    return found, d, measured + n


def enough_beam(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], least: int, recall: float, members: bool, k: int = 10, asked: int = 256) -> int:
    """The beam, doubled from ``least`` on, whose walks find ``recall`` of the ``k`` nearest others of sampled nodes; the whole graph at most.

    Nodes of the lowest layer only are asked. Unless queries are ``members``, their walks pass by themselves: a query that isn't in the graph has no links of its own either.
    """
    low = np.setdiff1d(np.arange(len(x)), layers[1][0]) if len(layers) > 1 else np.arange(1, len(x))
    if not len(low):
        return least
    at = low[np.linspace(0, len(low) - 1, min(asked, len(low))).astype(np.int64)]
    take = min(k, len(x) - 1)
    d = squared_distances(x[at], x)
    d[np.arange(len(at)), at] = np.inf
    reach = np.partition(d, take - 1, axis=1)[:, take - 1] * (1 + 1e-9) + 1e-12  # of equally far ones any will do
    beam = max(least, take + int(members))
    while beam < len(x):
        _, far, _ = search(x, layers, x[at], beam, None if members else at)
        if (far[:, int(members) : take + int(members)] <= reach[:, None]).sum() >= recall * len(at) * take:
            break
        beam = min(2 * beam, len(x))
    return beam


class GraphIndex(VectorIndex):
    """Graphs of up to ``nodes`` rows with ``m`` links a node (``lowest`` on the lowest layer, twice as many if not given); ``wide`` candidates are looked at for a link, ``beam`` nodes held in a walk.

    ``beam`` is the least number: for each graph it is doubled until ``recall`` of the ten nearest of sampled nodes are found in it, by walks that
    pass by the node itself if the batch fills several graphs, as a row is in one of them only. With ``recall`` None,
    or a beam named in a search, it stays as given.
    Each added batch gets graphs of its own. Nothing is learned: ``train`` notes the vectors' length.
    """

    kind = "HNSW"

    def __init__(self, spark, path: str, m: int = 32, wide: int = 128, beam: int = 64, nodes: int = 8192, lowest: int | None = None, seed: int = 42, recall: float | None = 0.95, **settings):
        super().__init__(spark, path, m=m, lowest=lowest or 2 * m, wide=wide, beam=beam, nodes=nodes, seed=seed, recall=recall, **settings)

    def _pack(self, rows: DataFrame) -> DataFrame:
        s = self.settings
        # Even parts, of at most ``nodes`` rows where the number of rows can be told beforehand.
        parts = max(-(-rows.count() // s["nodes"]), 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors = [], []

            def graph() -> pd.DataFrame:
                own, x = np.array(ids, np.int64), np.stack(vectors)
                order, layers = build(own, x, s["m"], s["lowest"], s["wide"], s["seed"])
                beam = s["beam"] if s["recall"] is None else enough_beam(x[order], layers, s["beam"], s["recall"], parts == 1)
                row = {
                    "cell": 0, "beam": beam, "dim": x.shape[1], "n": len(own), "least": own.min(), "most": own.max(), "ids": own[order].tobytes(), "block": x[order].tobytes(),
                    "nodes": [a.astype(np.int32).tobytes() for a, _ in layers], "links": [b.tobytes() for _, b in layers],
                }
                ids.clear(), vectors.clear()
                return pd.DataFrame([row])

            for b in batches:
                for i, v in zip(b["id"], b["v"]):
                    ids.append(i)
                    vectors.append(v)
                    if len(ids) == s["nodes"]:
                        yield graph()
            if ids:
                yield graph()

        dealt = rows.repartition(parts, F.xxhash64("id"))
        return dealt.mapInPandas(run, "cell int, beam int, dim int, n long, least long, most long, ids binary, block binary, nodes array<binary>, links array<binary>")

    def _asked(self, queries: DataFrame) -> DataFrame:
        return self._rows(queries).select("id", F.lit(0).alias("cell"), "v")

    def _work(self, k: int, beam: int | None = None):
        m, lowest = self.settings["m"], self.settings["lowest"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for u in b.itertuples(index=False):
                    ids, x = np.frombuffer(u.ids, np.int64), np.frombuffer(u.block, np.float64).reshape(-1, u.dim)
                    layers = [
                        (np.frombuffer(a, np.int32), np.frombuffer(e, np.int32).reshape(-1, m if i else lowest)) for i, (a, e) in enumerate(zip(u.nodes, u.links))
                    ]
                    q_ids, q = np.frombuffer(u.q_ids, np.int64), np.frombuffer(u.q_block, np.float64).reshape(-1, u.dim)
                    for at in range(0, len(q), 256):
                        found, d, measured = search(x, layers, q[at : at + 256], max(beam or u.beam, k))
                        found, d = found[:, :k], d[:, :k]
                        hit = np.isfinite(d)
                        rows = np.nonzero(hit)[0]
                        yield pd.DataFrame({"query_id": q_ids[at : at + 256][rows], "ref_id": ids[found[hit]], "d2": d[hit], "measured": measured[rows]})

        return run
