"""Exact nearest neighbours by blocks: the pairwise work of all vector operators.

Vectors are packed into blocks of bounded size; every pair of a query block and
a reference block is one row and one unit of work, a matrix product in numpy.
Neither side is broadcast whole or collected, and a unit's memory is that of two
blocks. Results of units meet in a ranked window or a grouped sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

BLOCK = 2048


def packed(rows: DataFrame, id_col: str, vector_col: str, size: int = BLOCK, tag_col: str | None = None, prefix: str = "") -> DataFrame:
    """(dim, ids, tags, block): up to ``size`` vectors of one length; a tag is a whole number of each.

    Null ids and null or empty vectors are left out.
    """
    tag = F.coalesce(F.col(tag_col).cast("long"), F.lit(-1)) if tag_col else F.lit(0).cast("long")
    use = rows.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(vector_col).cast("array<double>").alias("v")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def pack(dim: int) -> pd.DataFrame:
            part = held.pop(dim)
            ids, tags = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64)
            block = np.ascontiguousarray(np.stack([p[2] for p in part]), np.float64)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "tags": [tags.tobytes()], "block": [block.tobytes()]})

        for b in batches:
            for i, t, v in zip(b["id"], b["tag"], b["v"]):
                held.setdefault(len(v), []).append((i, t, v))
                if len(held[len(v)]) >= size:
                    yield pack(len(v))
        for dim in list(held):
            yield pack(dim)

    out = use.mapInPandas(run, "dim int, ids binary, tags binary, block binary")
    return out.select(*[F.col(c).alias(prefix + c) for c in out.columns])


def packed_by(rows: DataFrame, keys: list[str], size: int = BLOCK, prefix: str = "") -> DataFrame:
    """(keys, dim, n, least, most, ids, block) of rows (id, keys, v) that are sorted by whole-number keys within their partitions.

    A block has up to ``size`` vectors of one key and one length; ``least`` and ``most`` are the smallest and largest of its ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        at: tuple | None = None

        def pack(dim: int) -> pd.DataFrame:
            ids, vectors = held.pop(dim)
            own, block = np.array(ids, np.int64), np.ascontiguousarray(np.stack(vectors), np.float64)
            row = dict(zip(keys, at)) | {"dim": dim, "n": len(own), "least": own.min(), "most": own.max(), "ids": own.tobytes(), "block": block.tobytes()}
            return pd.DataFrame([row])

        for b in batches:
            for key, i, v in zip(zip(*(b[c] for c in keys)), b["id"], b["v"]):
                if key != at:
                    for dim in list(held):
                        yield pack(dim)
                    at = key
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) >= size:
                    yield pack(len(v))
        for dim in list(held):
            yield pack(dim)

    whole = ", ".join(f"{k} int" for k in keys)
    out = rows.select("id", *keys, "v").mapInPandas(run, f"{whole}, dim int, n long, least long, most long, ids binary, block binary")
    return out.select(*keys, *[F.col(c).alias(prefix + c) for c in out.columns if c not in keys]) if prefix else out


#: Bytes of the larger side, by the planner's estimate, for each row and column of a grid.
SHARE = 4 << 20


def parts(*frames: DataFrame) -> int:
    """Into how many parts each side of a grid goes: a few units a core, fewer where the planner expects little."""
    size = max(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in frames)
    most = math.isqrt(4 * frames[0].sparkSession.sparkContext.defaultParallelism) + 1
    return max(1, min(most, size // SHARE))


#: Rows that a task holds of what it found for query blocks before it passes them on.
HELD = 1 << 20


def by_blocks(
    queries: DataFrame, reference: DataFrame, work: Callable, schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame], whole: bool = False
) -> DataFrame:
    """Runs ``work(q_ids, q_tags, q, ids, tags, block)`` on every pair of packed blocks of one length.

    What a task found for one query block is put together by ``merge``, so that a task's rows grow with its queries and not with its pairs.

    Blocks are dealt out to the rows and columns of a grid by hash: a query block goes to all units of its row, a reference block to all of its
    column, and the two meet in one. So no key gathers more than a row's and a column's share, however few lengths there are. With ``whole`` the grid
    has one column: a query block meets all of the reference in one task, for results that are large for each query.
    """
    n = parts(queries, reference)
    rows, columns = (n * n, 1) if whole else (n, n)
    part = lambda key, many: F.pmod(F.xxhash64(key), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    down = queries.withColumn("across", part("q_ids", rows)).withColumn("down", every(columns))
    across = reference.withColumn("down", part("ids", columns)).withColumn("across", every(rows))
    pairs = across.withColumnRenamed("dim", "q_dim").join(down, ["q_dim", "across", "down"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, pd.DataFrame] = {}
        for b in batches:
            for u in b.itertuples(index=False):
                sides = []
                for ids, tags, block in ((u.q_ids, u.q_tags, u.q_block), (u.ids, u.tags, u.block)):
                    sides += [np.frombuffer(ids, np.int64), np.frombuffer(tags, np.int64), np.frombuffer(block, np.float64).reshape(-1, u.q_dim)]
                more = work(*sides)
                found[u.q_ids] = merge(pd.concat([found[u.q_ids], more])) if u.q_ids in found else more
                if sum(map(len, found.values())) > HELD:
                    yield from found.values()
                    found = {}
        yield from found.values()

    return pairs.mapInPandas(run, schema)


def squared_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * (q @ c.T)
    return np.maximum(d, 0)


def nearest_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, exclude_self: bool = False) -> pd.DataFrame:
    """(query_id, ref_id, d2): of one pair of blocks, the ``k`` nearest of each query."""
    d = squared_distances(q, c)
    if exclude_self:
        d[q_ids[:, None] == ids[None, :]] = np.inf
    take = min(k + 2, d.shape[1])
    at = np.argpartition(d, take - 1, axis=1)[:, :take]
    # The few that count are measured again by differences, without cancellation.
    exact = ((q[:, None, :] - c[at]) ** 2).sum(2)
    exact[~np.isfinite(np.take_along_axis(d, at, 1))] = np.inf
    rows = pd.DataFrame({"query_id": np.repeat(q_ids, take), "ref_id": ids[at].ravel(), "d2": exact.ravel()})
    rows = rows[np.isfinite(rows["d2"])].sort_values(["query_id", "d2", "ref_id"])
    return rows.groupby("query_id").head(k)


def unit_top(k: int) -> Callable:
    """For pairs of blocks (q_ids, q_block, ids, block, dim): the nearest of each query in a task, with the number of distances measured for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, tuple[pd.DataFrame, int]] = {}
        for b in batches:
            for u in b.itertuples(index=False):
                sides = [(np.frombuffer(i, np.int64), np.frombuffer(x, np.float64).reshape(-1, u.dim)) for i, x in ((u.q_ids, u.q_block), (u.ids, u.block))]
                hits, n = nearest_of(*sides[0], *sides[1], k), len(sides[1][0])
                if u.q_ids in found:
                    hits, n = pd.concat([found[u.q_ids][0], hits]).sort_values(["query_id", "d2", "ref_id"]).groupby("query_id").head(k), n + found[u.q_ids][1]
                found[u.q_ids] = hits, n
                if sum(len(h) for h, _ in found.values()) > HELD:
                    yield from (h.assign(measured=m) for h, m in found.values())
                    found = {}
        yield from (h.assign(measured=m) for h, m in found.values())

    return run


def nearest(
    queries: DataFrame, reference: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    exclude_self: bool = False, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, ref_id, d2): the ``k`` nearest reference rows of each query.

    Squared Euclidean distances, ties to the smaller id; all rows where the reference has
    fewer than ``k``. With ``exclude_self``, a row of the query's own id is no neighbour.
    """
    found = by_blocks(
        packed(queries, id_col, vector_col, min(block, 1024), prefix="q_"), packed(reference, id_col, vector_col, block),
        lambda q_ids, _, q, ids, __, c: nearest_of(q_ids, q, ids, c, k, exclude_self), "query_id long, ref_id long, d2 double",
        lambda hits: hits.sort_values(["query_id", "d2", "ref_id"]).groupby("query_id").head(k),
    )
    order = Window.partitionBy("query_id").orderBy("d2", "ref_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "d2")


def counted(near: DataFrame, times: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, d2, n): ``nearest`` of distinct vectors, each standing for as many rows as ``times`` (id, times) says, cut at ``k`` rows.

    ``n`` is how many of the ``k`` lie at ``d2``. With ``exclude_self``, one row of the query's own vector is no neighbour;
    ``near`` then has a rank more.
    """
    t = times.select(F.col("id").alias("ref_id"), F.col("times"))
    if exclude_self:
        n = F.col("times") - (F.col("query_id") == F.col("ref_id")).cast("long")
    else:
        n = F.col("times")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = near.join(t, "ref_id").withColumn("n", n).withColumn("n", F.least(F.col("n"), F.lit(k) - before))
    return rows.where("n > 0").select("query_id", "d2", "n")


def search(
    vectors: DataFrame, query: list[float], k: int = 10, min_similarity: float | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, distance, similarity) of the ``k`` rows nearest to one vector: TakeOrderedAndProject, no shuffle of the table."""
    d2 = V.squared_l2(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    hits = vectors.select(F.col(id_col).alias("id"), d2.alias("distance")).orderBy("distance", "id").limit(k)
    hits = hits.withColumn("similarity", V.similarity(F.col("distance")))
    return hits if min_similarity is None else hits.where(F.col("similarity") >= min_similarity)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, min_similarity: float | None = None, **names) -> DataFrame:
    """(query_id, rank, id, distance, similarity) for many query vectors."""
    hits = nearest(queries, vectors, k, **names).select(
        "query_id", "rank", F.col("ref_id").alias("id"), F.col("d2").alias("distance"), V.similarity(F.col("d2")).alias("similarity")
    )
    return hits if min_similarity is None else hits.where(F.col("similarity") >= min_similarity)


def with_metadata(hits: DataFrame, metadata: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with their metadata; a hit without any stays, its metadata null."""
    return hits.join(metadata, id_col, "left")
