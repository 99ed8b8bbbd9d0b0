"""Exact top-k inner products by columnar branch and bound.

Vectors are packed into blocks laid out by dimension. Every pair of a query
block and a candidate block is one unit of work: dimensions are taken in order of the
candidates' energy, inner products accumulate one block of dimensions after another,
and after each the Cauchy-Schwarz bound on what the remaining dimensions can still
add drops candidates that can't reach the query's k-th best score so far. A task
carries that score from unit to unit, so it rises as candidate blocks go by. While
many candidates survive, the next block of dimensions is a dense product; from
``dense`` on, which is about where gathering pays, the survivors are compacted and only they go on.
Results of the units are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256


def _scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): integer components floor(256 * x); rows that can't take part are gone."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    return usable.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double")).alias("v"),
    )


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(dim, ids, block): up to ``size`` vectors of one length; the block is dimension by dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def pack(dim: int) -> pd.DataFrame:
            part = held.pop(dim)
            ids = np.array([i for i, _ in part], np.int64)
            block = np.ascontiguousarray(np.stack([v for _, v in part]).T)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "block": [block.tobytes()]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["v"]):
                held.setdefault(len(v), []).append((i, np.asarray(v, np.float64)))
                if len(held[len(v)]) >= size:
                    yield pack(len(v))
        for dim in list(held):
            yield pack(dim)

    return common.mapped(rows, run, "dim int, ids binary, block binary", 4096)


def _search(q_ids, q, c_ids, c, k: int, step: int, dense: float, floor: np.ndarray | None = None, shares: list | None = None):
    """Top ``k`` of one unit: arrays (query row, candidate row, score). ``q`` and ``c`` are (dim, n).

    ``floor``: scores that ``k`` candidates of each query are known to reach. ``shares`` gets
    the share of candidates that survive each block of dimensions.
    """
    order = np.argsort(-(c**2).sum(1), kind="stable")
    q, c = q[order], c[order]
    dims, n = c.shape
    cuts = list(range(0, dims, step))
    # Norms of what lies beyond each cut.
    q_rest = [np.sqrt((q[at + step :] ** 2).sum(0)) for at in cuts]
    c_rest = [np.sqrt((c[at + step :] ** 2).sum(0)) for at in cuts]
    total = np.zeros((q.shape[1], n))
    alive = q_ids[:, None] != c_ids[None, :]
    floor = np.full(q.shape[1], -np.inf) if floor is None else floor
    pairs = None
    for number, at in enumerate(cuts):
        last = number == len(cuts) - 1
        if pairs is None:
            total += q[at : at + step].T @ c[at : at + step]
            if last:
                break
            if number == 0 and n > 2 * k and not np.isfinite(floor).all():
                # The full scores of the best beginnings give the first floor.
                head = np.argpartition(np.where(alive, -total, np.inf), 2 * k - 1, axis=1)[:, : 2 * k]
                full = np.einsum("dq,dqk->qk", q, c[:, head])
                full[~np.take_along_axis(alive, head, 1)] = -np.inf
                floor = np.maximum(floor, -np.partition(-full, k - 1, axis=1)[:, k - 1])
            least = floor - 1e-6 * np.abs(floor)
            alive &= total + q_rest[number][:, None] * c_rest[number][None, :] >= least[:, None]
            share = alive.mean()
            if share < dense:
                pairs = np.nonzero(alive)
                score = total[pairs]
        else:
            qi, ci = pairs
            score = score + np.einsum("dp,dp->p", q[at : at + step, qi], c[at : at + step, ci])
            if not last:
                keep = score + q_rest[number][qi] * c_rest[number][ci] >= least[qi]
                pairs, score = (qi[keep], ci[keep]), score[keep]
                share = len(score) / alive.size
        if shares is not None and not last:
            shares.append(float(share))
    if pairs is None:
        pairs = np.nonzero(alive & (total >= (floor - 1e-6 * np.abs(floor))[:, None]))
        score = total[pairs]
    qi, ci = pairs
    order = np.lexsort((c_ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    first = np.concatenate(([True], qi[1:] != qi[:-1])) if len(qi) else np.zeros(0, bool)
    rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
    return qi[rank < k], ci[rank < k], score[rank < k]


class _Floors:
    """The ``k`` best scores so far of the queries of each block that a task has met; as many numbers as results."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def of(self, key: bytes, n: int) -> np.ndarray:
        if key not in self.best:
            self.best[key] = np.full((n, self.k), -np.inf)
        return self.best[key][:, -1].copy()

    def add(self, key: bytes, qi: np.ndarray, score: np.ndarray) -> None:
        best = self.best[key]
        new = np.full_like(best, -np.inf)
        first = np.searchsorted(qi, qi)
        new[qi, np.arange(len(qi)) - first] = score
        both = np.concatenate([best, new], axis=1)
        self.best[key] = -np.sort(-both, axis=1)[:, : self.k]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    block: int = 4096,
    query_block: int = 256,
    step: int = 16,
    dense: float = 0.05,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query.

    Components are floor(256 * x). A query's own row (same id) is no candidate of
    its; ties go to the smaller vec_id; a query with fewer candidates gets them
    all, and vectors of another length are none. Null vectors or ids, empty
    vectors and those with null or non-finite components take no part. Of rows
    repeating an id, each is a candidate, and a repeated query gets one list.
    Scores are exact while sums of products stay below 2**53. An empty table
    gives an empty result.
    """
    candidates = _packed(_scaled(vectors, id_col, vector_col), block)
    asked = _packed(
        _scaled(queries, id_col, vector_col).dropDuplicates(["vec_id"]), query_block
    )
    # Both sides are small numbers of packed blocks: (rows / block) * (queries / query_block) units.
    asked = common.durable(asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("block").alias("q_block")), "asked")
    candidates = common.durable(candidates.repartition(F.xxhash64("ids")), "candidates")
    # One length is the rule and would be a single hot key: candidate blocks are dealt to parts, and the queries, the smaller side, to each part.
    parts = 64
    candidates = candidates.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Merged: the planner knows the size of the queries before they are exploded only, and might broadcast them.
    units = candidates.hint("merge").join(asked, (F.col("dim") == F.col("q_dim")) & (F.col("part") == F.col("q_part")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors = _Floors(k)
        for batch in batches:
            for u in batch.itertuples(index=False):
                c_ids, q_ids = np.frombuffer(u.ids, np.int64), np.frombuffer(u.q_ids, np.int64)
                c = np.frombuffer(u.block, np.float64).reshape(u.dim, -1)
                q = np.frombuffer(u.q_block, np.float64).reshape(u.dim, -1)
                qi, ci, score = _search(q_ids, q, c_ids, c, k, step, dense, floors.of(u.q_ids, len(q_ids)))
                floors.add(u.q_ids, qi, score)
                yield pd.DataFrame({"query_id": q_ids[qi], "vec_id": c_ids[ci], "score": score.astype(np.int64)})

    found = units.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: The contract of op8 in SQL: queries are rows whose id is divisible by 50.
ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
