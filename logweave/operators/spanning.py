"""The spanning tree over mutual reachability of very many vectors, by Boruvka's rounds over blocks that lie together in space.

Vectors are dealt out to the nearest of a few far-apart pivots and packed into blocks. Every pair of blocks meets once, in one unit of a
grid whose sides are bounded. A row takes part in a pair only if the ball around the other block and the gap between both blocks along
the line of their centres let a row of it lie within the row's bound: for neighbours, the distance of the last one found so far, for a
component, its lightest edge so far. Both are exact bounds, so nothing is lost. Products are in single precision, loosened by
their rounding; what passes is measured again by differences.

Lists of ``k + MORE`` neighbours give most of the tree: a component's lightest listed edge is its lightest one if it is lighter than the
last listed distance of each of its rows. Only components of which that isn't so ask all blocks, with the rows that can have a lighter edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import held
from . import knn

PIVOTS, SAMPLE, BLOCK = 32, 4096, 2048
#: Bytes of vectors on a side of a unit, neighbours listed beyond the core's, candidates measured at once, rows of a block that stand for its components.
SIDE, MORE, AT_ONCE, SHOWN = 64 << 20, 3, 1 << 17, 32
SLACK = 1e-9


def _pivots(x: np.ndarray) -> np.ndarray:
    """Rows far apart: each next one is the farthest from those before."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < PIVOTS:
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return x[chosen]


def _nearest_listed(x: np.ndarray, k: int) -> np.ndarray:
    """Squares of distances to the ``k``-th other row of a block; infinite where it has fewer."""
    if len(x) <= k:
        return np.full(len(x), np.inf)
    d = knn.squared_distances(x, x)
    np.fill_diagonal(d, -1.0)
    near = np.argpartition(d, k, axis=1)[:, : k + 1]
    return ((x[:, None, :] - x[near]) ** 2).sum(2).max(1) * (1 + SLACK)


def _packed(distinct: DataFrame, k: int) -> DataFrame:
    """(part, ids, dim, block, reach) of distinct vectors (v, id); ``reach`` bounds the square of each row's ``k``-th neighbour."""
    some = distinct.select("v").orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()["v"]
    dim = int(some.map(len).mode()[0])
    pivots = _pivots(np.stack([v for v in some if len(v) == dim]).astype(float))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.full(len(b), len(pivots))
            fits = (b["v"].map(len) == dim).to_numpy(bool)
            if fits.any():
                cell[fits] = knn.squared_distances(np.stack(b["v"][fits].to_numpy()), pivots).argmin(1)
            yield b.assign(cell=cell)

    rows = held(distinct.select("id", "v").mapInPandas(dealt, "id long, v array<double>, cell int"))
    sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    many = F.array(*[F.lit(max(1, -(-sizes.get(c, 0) // BLOCK))) for c in range(len(pivots) + 1)])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.element_at(many, F.col("cell") + 1)).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_numpy()).astype(float)
        return pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "dim": [x.shape[1]], "block": [x.tobytes()], "reach": [_nearest_listed(x, k).tobytes()]})

    blocks = rows.groupBy("cell", "salt", F.size("v")).applyInPandas(pack, "ids binary, dim int, block binary, reach binary")
    size = 8 * dim * sum(sizes.values())
    parts = max(knn.parts(distinct), -(-size // SIDE))
    return held(blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(int(parts))).cast("int")).withColumn("parts", F.lit(int(parts))))


class _Block:
    def __init__(self, row) -> None:
        self.ids, self.part = np.frombuffer(row.ids, np.int64), row.part
        self.x = np.frombuffer(row.block, np.float64).reshape(-1, row.dim)
        self.centre = self.x.mean(0)
        self.radius = np.sqrt(((self.x - self.centre) ** 2).sum(1).max())
        self.reach = np.frombuffer(row.reach, np.float64).copy()


def _bounds(q: _Block, c: _Block) -> np.ndarray:
    """For each row of ``q``, a lower bound of the square of its distance to any row of ``c``."""
    w = c.centre - q.centre
    far = np.linalg.norm(w)
    least = np.sqrt(((q.x - c.centre) ** 2).sum(1)) - c.radius
    if far > 0:
        w = w / far
        least = np.maximum(least, (c.x @ w).min() - q.x @ w)
    return np.maximum(least - SLACK * (far + q.radius + c.radius + np.abs(c.centre).max()), 0) ** 2


def _near(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, squares less their rounding) of all pairs whose square can be within their row's bound, in single precision."""
    middle = q.mean(0)
    a, b = (q - middle).astype(np.float32), (c - middle).astype(np.float32)
    aa, bb = (a**2).sum(1), (b**2).sum(1)
    slack = 4 * (q.shape[1] + 8) * 2.0**-24 * (np.sqrt(aa) + np.sqrt(bb.max())) ** 2
    left = np.hstack([a, aa[:, None] / -2, np.ones((len(a), 1), np.float32)])
    h = left @ np.hstack([b, np.ones((len(b), 1), np.float32), bb[:, None] / -2]).T
    limit = np.where(np.isfinite(bound), -(bound + slack) / 2, -np.inf)
    # Rounded down, so that the comparison in single precision keeps what is on the limit.
    at = np.flatnonzero(h >= np.nextafter(limit.astype(np.float32), np.float32(-np.inf))[:, None])
    rows = at // len(c)
    return rows, at % len(c), np.maximum(-2.0 * h.ravel()[at] - slack[rows], 0)


def _met(part: pd.DataFrame) -> tuple[list[_Block], list[tuple[_Block, _Block]]]:
    """A unit's blocks, and its pairs of blocks of one length, near ones first."""
    blocks = [_Block(r) for r in part.itertuples(index=False)]
    low = min(b.part for b in blocks)
    one, other = [b for b in blocks if b.part == low], [b for b in blocks if b.part != low]
    pairs = combinations_with_replacement(one, 2) if part["a"].iloc[0] == part["b"].iloc[0] else product(one, other)
    pairs = [(q, c) for q, c in pairs if q.x.shape[1] == c.x.shape[1]]
    return blocks, sorted(pairs, key=lambda p: ((p[0].centre - p[1].centre) ** 2).sum())


def _units(blocks: DataFrame) -> DataFrame:
    """Each block to every unit (a, b) of its row and column of the grid, a <= b: two blocks of different parts meet in one."""
    n = blocks.select("parts").first()[0]
    x = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    units = blocks.drop("parts").withColumn("x", x).withColumn("a", F.least("part", "x")).withColumn("b", F.greatest("part", "x")).drop("x")
    return units.repartition(2 * n * (n + 1), "a", "b").groupBy("a", "b")


def neighbours(blocks: DataFrame, k: int) -> DataFrame:
    """(id, ref, d2): the ``k`` nearest others of each row, ties to the smaller id."""

    def unit(part: pd.DataFrame) -> pd.DataFrame:
        met, pairs = _met(part)
        found: dict[int, list] = {id(b): [] for b in met}

        def trimmed(b: _Block) -> None:
            r, ref, d = (np.concatenate(y) for y in zip(*found[id(b)]))
            by = np.lexsort((ref, d, r))
            r, ref, d = r[by], ref[by], d[by]
            starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
            keep, last = rank < k, rank == k - 1
            b.reach[r[last]] = np.minimum(b.reach[r[last]], d[last])
            found[id(b)] = [(r[keep], ref[keep], d[keep])]

        def search(q: _Block, c: _Block) -> None:
            rows = np.flatnonzero(_bounds(q, c) <= q.reach)
            if not len(rows):
                return
            r, s, _ = _near(q.x[rows], c.x, q.reach[rows])
            r = rows[r]
            other = q.ids[r] != c.ids[s]
            r, s = r[other], s[other]
            for at in range(0, len(r), AT_ONCE):
                i, j = r[at : at + AT_ONCE], s[at : at + AT_ONCE]
                d = ((q.x[i] - c.x[j]) ** 2).sum(1)
                use = d <= q.reach[i]
                found[id(q)].append((i[use], c.ids[j][use], d[use]))
                if sum(len(y[0]) for y in found[id(q)]) > 3 * k * len(q.ids):
                    trimmed(q)

        for q, c in pairs:
            search(q, c)
            if q is not c:
                search(c, q)
        out = [pd.DataFrame({"id": np.zeros(0, np.int64), "ref": np.zeros(0, np.int64), "d2": np.zeros(0)})]
        for b in met:
            if found[id(b)]:
                trimmed(b)
                (r, ref, d), = found[id(b)]
                out.append(pd.DataFrame({"id": b.ids[r], "ref": ref, "d2": d}))
        return pd.concat(out)

    order = Window.partitionBy("id").orderBy("d2", "ref")
    near = _units(blocks).applyInPandas(unit, "id long, ref long, d2 double")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _lightest(c: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of each component's first edge by (weight, a, b)."""
    by = np.lexsort((b, a, w, c))
    return by[np.concatenate(([True], c[by][1:] != c[by][:-1]))] if len(by) else by


def _asked(blocks: DataFrame, ids: np.ndarray, core: np.ndarray, component: np.ndarray, ask: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight): the lightest of each component whose rows ``ask``, where it is no heavier than its ``bound``."""
    state = blocks.sparkSession.sparkContext.broadcast((ids, core, component, ask, bound))

    def unit(part: pd.DataFrame) -> pd.DataFrame:
        ids, core, component, ask, bound = state.value
        met, pairs = _met(part)
        best, edges = bound.copy(), []
        for b in met:
            b.at = np.searchsorted(ids, b.ids)
            b.c, b.core, b.ask = component[b.at], core[b.at], ask[b.at]
            b.single = b.c[0] if (b.c == b.c[0]).all() else -1

        def measured(q: _Block, c: _Block, i: np.ndarray, j: np.ndarray) -> None:
            w = np.maximum(np.sqrt(((q.x[i] - c.x[j]) ** 2).sum(1)), np.maximum(q.core[i], c.core[j]))
            use = w <= best[q.c[i]]
            i, j, w = i[use], j[use], w[use]
            a, b, of = np.minimum(q.at[i], c.at[j]), np.maximum(q.at[i], c.at[j]), q.c[i]
            first = _lightest(of, w, a, b)
            best[of[first]] = w[first]
            edges.append((of[first], w[first], a[first], b[first]))

        def search(q: _Block, c: _Block, rows: np.ndarray, columns: np.ndarray) -> None:
            r, s, d2 = _near(q.x[rows], c.x[columns], best[q.c[rows]] ** 2)
            r, s = rows[r], columns[s]
            apart = q.c[r] != c.c[s]
            r, s, d2 = r[apart], s[apart], d2[apart]
            while len(r):
                # The nearest first, so that the rest is mostly over the bound by then.
                if len(r) > AT_ONCE:
                    near = np.argpartition(d2, AT_ONCE)
                    r, s, d2 = r[near], s[near], d2[near]
                measured(q, c, r[:AT_ONCE], s[:AT_ONCE])
                r, s, d2 = r[AT_ONCE:], s[AT_ONCE:], d2[AT_ONCE:]
                use = np.maximum(np.sqrt(d2), np.maximum(q.core[r], c.core[s])) <= best[q.c[r]]
                r, s, d2 = r[use], s[use], d2[use]

        turns = [t for q, c in pairs for t in ([(q, c)] if q is c else [(q, c), (c, q)]) if not (q.single >= 0 and q.single == c.single)]
        # A few rows of each block first: they bound the components that have no edge yet.
        for q, c in turns:
            if q.ask.any():
                search(q, c, np.flatnonzero(q.ask)[:SHOWN], np.arange(min(SHOWN, len(c.ids))))
        for q, c in turns:
            most = best[q.c]
            rows = np.flatnonzero(q.ask & (q.core <= most) & (_bounds(q, c) <= most**2))
            if len(rows):
                columns = np.flatnonzero(c.core <= most[rows].max())
                if len(columns):
                    search(q, c, rows, columns)
        of, w, a, b = (np.concatenate(y) for y in zip(*edges)) if edges else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        first = _lightest(of, w, a, b)
        return pd.DataFrame({"component": of[first], "a": a[first], "b": b[first], "w": w[first]})

    found = _units(blocks).applyInPandas(unit, "component long, a long, b long, w double")
    least = found.groupBy("component").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w")
    out = least.toPandas().to_numpy(np.float64).reshape(-1, 3)
    state.unpersist()
    return out


def merged(found: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges taken, components): edges (a, b, weight) by weight, those that close a circle left out."""
    parent = np.arange(len(component)).tolist()

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    taken = []
    for i in np.lexsort((found[:, 1], found[:, 0], found[:, 2])).tolist():
        p, q = root(int(component[int(found[i, 0])])), root(int(component[int(found[i, 1])]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            taken.append(i)
    top = np.array([root(v) for v in range(len(parent))], np.int64)
    return found[taken], top[component]


def tree(distinct: DataFrame, ids: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, core): the spanning tree (a, b, weight) and the core distances of distinct vectors (v, id), each standing for ``times`` rows.

    ``ids`` ascend; a and b are positions in them. ``k`` rows around each make its core distance.
    """
    n, most = len(ids), k + MORE
    blocks = _packed(distinct, most)
    # By Arrow: rows of Python objects would take ten times the memory.
    near = neighbours(blocks, most).toArrow()
    a, b, d = np.searchsorted(ids, near["id"].to_numpy()), np.searchsorted(ids, near["ref"].to_numpy()), np.sqrt(near["d2"].to_numpy())
    del near
    by = np.lexsort((b, d, a))
    a, b, d = a[by], b[by], d[by]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    far, rows = np.full((n, most), np.inf), np.zeros((n, most), np.int64)
    far[a, rank], rows[a, rank] = d, times[b]
    enough = (np.cumsum(rows, axis=1) + times[:, None] - 1 >= k).argmax(1)
    core = np.where(times - 1 >= k, 0.0, far[np.arange(n), enough])
    # Beyond the listed ones nobody is nearer than the last; all others are listed where there are fewer.
    last = far[:, -1]
    w = np.maximum(d, np.maximum(core[a], core[b]))
    a, b = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((b, a, w))
    a, b, w = a[by], b[by], w[by]
    component, edges = np.arange(n), []
    while component.any():
        apart = component[a] != component[b]
        a, b, w = a[apart], b[apart], w[apart]
        # Edges ascend, and of several assignments the last one stays.
        first = np.full(n, -1)
        for side in (b, a):
            turned = np.full(n, -1)
            turned[component[side][::-1]] = np.arange(len(a))[::-1]
            first = np.where(first < 0, turned, np.where(turned < 0, first, np.minimum(first, turned)))
        bound = np.where(first >= 0, w[first] if len(w) else np.inf, np.inf)
        least = np.full(n, np.inf)
        np.minimum.at(least, component, last)
        sure = (first >= 0) & (bound < least)
        if sure.any():
            use = np.unique(first[sure])
            found = np.stack([a[use], b[use], w[use]], axis=1)
        else:
            sizes = np.bincount(component, minlength=n)
            # The largest component waits for the others to find it.
            ask = (component != sizes.argmax()) & (last <= bound[component])
            asked = _asked(blocks, ids, core, component, ask, bound)
            listed = np.unique(first[first >= 0])
            found = np.concatenate([asked, np.stack([a[listed], b[listed], w[listed]], axis=1)]) if len(listed) else asked
            # A listed edge counts where the component found no lighter one.
            ends = component[found[:, :2].astype(np.int64)]
            of, twice = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([found, found])
            own = of != sizes.argmax()
            of, twice = of[own], twice[own]
            found = np.unique(twice[_lightest(of, twice[:, 2], twice[:, 0], twice[:, 1])], axis=0)
            if not len(found):
                raise ValueError("vectors of different lengths")
        taken, component = merged(found, component)
        edges.append(taken)
    return (np.concatenate(edges) if edges else np.empty((0, 3))), core
