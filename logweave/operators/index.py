"""Vector indexes that live on disk: exact, by inverted lists, and by layered graphs.

An index is a folder: a manifest with its kind, settings and cells' centres, and
its rows as Parquet partitioned by cell, packed into blocks of vectors. It is
trained once; ``add`` assigns and appends new rows only; a search reads the
cells that its queries probe and no others. Any session can open it again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import deleted, held, scratch
from . import knn

ROW = "id long, cell int, v array<double>"
#: Blocks of a cell, and queries of a cell, that meet in one task.
BLOCKS, ASKED = 32, 8192
#: Sampled rows that a cell's centre is learned from, on average, at most.
PER_CELL = 256


def kmeans(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from the first rows on."""
    c = x[: min(lists, len(x))].copy()
    squares = (x**2).sum(1)[:, None]
    for _ in range(rounds):
        near = (squares - 2 * x @ c.T + (c**2).sum(1)[None, :]).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def enough_probes(x: np.ndarray, centres: np.ndarray, recall: float, k: int = 10, asked: int = 500) -> int:
    """How many cells hold ``recall`` of the ``k`` nearest neighbours of sampled rows, within the sample."""
    norms = (centres**2).sum(1)
    home = np.concatenate([(norms[None, :] - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)])
    q = x[:: max(len(x) // asked, 1)][:asked]
    turn = np.empty((len(q), len(centres)), np.int64)  # of each cell, when a query probes it
    np.put_along_axis(turn, np.argsort(norms[None, :] - 2 * q @ centres.T, axis=1, kind="stable"), np.arange(len(centres))[None, :], 1)
    squares, near, take = (x**2).sum(1)[None, :], [], min(k + 1, len(x))
    for i in range(0, len(q), 64):
        d = squares - 2 * q[i : i + 64] @ x.T
        some = np.argpartition(d, take - 1, axis=1)[:, :take]
        near.append(np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)[:, 1:])
    needed = np.sort(np.take_along_axis(turn, home[np.concatenate(near)], 1).ravel())
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) + 1 if len(needed) else 1


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of what units found for each query; ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy("d2", "ref_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "d2")


class VectorIndex:
    """What all kinds share. Ids are whole numbers; null ids and null or empty vectors are left out, and all vectors of an index have one length.

    An id that is added twice is there twice. ``load`` opens an index, ``index`` makes a new one.
    """

    kind = ""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding", **settings):
        self.spark, self.path, self.id_col, self.vector_col = spark, path.rstrip("/"), id_col, vector_col
        self.settings = settings
        self.centres: np.ndarray | None = None

    def _rows(self, df: DataFrame) -> DataFrame:
        use = F.col(self.id_col).isNotNull() & (F.size(self.vector_col) > 0)
        return df.where(use).select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vector_col).cast("array<double>").alias("v"))

    def _fit(self, x: np.ndarray) -> None:
        """Learns from a bounded sample."""

    def _pack(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def train(self, df: DataFrame, sample: int = 50_000, seed: int = 42) -> VectorIndex:
        """Learns the cells on at most ``sample`` rows, and no more than ``PER_CELL`` for each cell, those with the smallest keyed hashes, and writes the manifest.

        Rows that were added go.
        """
        most = min(sample, PER_CELL * self.settings.get("lists", 1))
        keyed = self._rows(df).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)
        values = keyed.select("v").toArrow().column("v").combine_chunks()
        if not len(values):
            raise ValueError("nothing to train on")
        dim = len(values[0])
        self._fit(values.flatten().to_numpy().reshape(-1, dim))
        self._write_manifest(dim)
        self.clear()
        return self

    def _write_manifest(self, dim: int) -> None:
        said = json.dumps({"kind": self.kind, "id_col": self.id_col, "vector_col": self.vector_col, "dim": dim, **self.settings}, sort_keys=True)
        centres = [] if self.centres is None else self.centres.tolist()
        rows = [(i, c, said) for i, c in enumerate(centres)] or [(0, None, said)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>, settings string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")

    def _manifest(self) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.path}/manifest").first()["settings"])

    def clear(self) -> None:
        """Deletes the rows; what was learned stays."""
        deleted(self.spark, f"{self.path}/blocks")
        empty = self._pack(self.spark.createDataFrame([], "id long, v array<double>")).drop("cell")
        empty.coalesce(1).write.parquet(f"{self.path}/blocks/cell=-1")  # so that the columns of an empty index are known

    def add(self, df: DataFrame) -> VectorIndex:
        """Assigns and appends the rows of ``df``; what is there isn't read."""
        dim = self._manifest()["dim"]
        rows = self._rows(df)
        same = F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit(f"vectors of length {dim} are indexed")).cast("array<double>"))
        self._pack(rows.withColumn("v", same)).write.mode("append").partitionBy("cell").parquet(f"{self.path}/blocks")
        return self

    def blocks(self) -> DataFrame:
        """Packed rows: cell, dim, n, least and most of the ids, and what the kind stores."""
        return self.spark.read.parquet(f"{self.path}/blocks").where("n > 0")

    def size(self) -> int:
        return self.blocks().agg(F.sum("n")).first()[0] or 0

    def stats(self) -> DataFrame:
        """(cell, rows, blocks) of the cells that have any; vectors aren't read."""
        return self.blocks().groupBy("cell").agg(F.sum("n").alias("rows"), F.count("*").alias("blocks"))

    def get(self, id_: int) -> DataFrame:
        """(id, embedding) of one id; blocks whose ids can't hold it are left out by their statistics."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for u in b.itertuples(index=False):
                    ids, block = np.frombuffer(u.ids, np.int64), np.frombuffer(u.block, np.float64).reshape(-1, u.dim)
                    at = np.flatnonzero(ids == id_)
                    if len(at):
                        yield pd.DataFrame({"id": ids[at], "embedding": list(block[at])})

        near = self.blocks().where((F.col("least") <= id_) & (F.col("most") >= id_))
        return near.select("dim", "ids", "block").mapInPandas(run, "id long, embedding array<double>")

    def save_as(self, path: str) -> VectorIndex:
        """A copy at another path."""
        self.spark.read.parquet(f"{self.path}/manifest").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        copy = load(self.spark, path)
        copy.clear()
        self.blocks().write.mode("append").partitionBy("cell").parquet(f"{path}/blocks")
        return copy

    def _asked(self, queries: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _work(self, k: int, **how):
        raise NotImplementedError

    def search(self, queries: DataFrame, k: int = 10, details: bool = False, **how) -> DataFrame:
        """(query_id, rank, ref_id, d2): the nearest rows of the cells that each query probes, by squared distance.

        Queries and blocks of a cell meet in a grid, so that neither a cell nor the queries that probe it
        gather in one task. With ``details`` the units' finds are returned: query_id, ref_id, d2 and ``measured``, the number
        of distances that the unit computed for the query.
        """
        asked = held(self._asked(queries))
        probed = asked.groupBy("cell").count()
        mine = {r["cell"]: r["count"] for r in probed.collect()}  # a row for each cell at most
        wanted = self.blocks().where(F.col("cell").isin(sorted(mine)))
        there = {r["cell"]: r["blocks"] for r in wanted.groupBy("cell").agg(F.count("*").alias("blocks")).collect()}
        rows = [(c, -(-n // ASKED), -(-there[c] // BLOCKS)) for c, n in mine.items() if c in there]
        grid = F.broadcast(self.spark.createDataFrame(rows, "cell int, across int, down int"))  # a row for each cell at most
        coordinate = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asked.join(grid, "cell").withColumn("q", coordinate("id", "across"))
        q = q.repartition("cell", "q").sortWithinPartitions("cell", "q")
        q = knn.packed_by(q, ["cell", "q"], 1024, "q_").join(grid, "cell").withColumn("r", every("down")).drop("across", "down")
        r = wanted.join(grid, "cell").withColumn("r", coordinate("least", "down")).withColumn("q", every("across")).drop("across", "down", "n", "least", "most")
        pairs = r.join(q, ["cell", "q", "r"])
        found = pairs.mapInPandas(self._work(k, **how), "query_id long, ref_id long, d2 double, measured long")
        return found if details else ranked(found, k)


class FlatIndex(VectorIndex):
    """Exact search: one cell, which every query probes."""

    kind = "Flat"

    def _cells(self, df: DataFrame, probes: int) -> DataFrame:
        return df.select("id", F.lit(0).alias("cell"), "v")

    def _pack(self, rows: DataFrame) -> DataFrame:
        # Rebalancing deals large cells out to several tasks and puts small ones together.
        own = self._cells(rows, 1).hint("rebalance", "cell").sortWithinPartitions("cell", "id")
        return knn.packed_by(own, ["cell"], knn.BLOCK)

    def _asked(self, queries: DataFrame) -> DataFrame:
        return self._cells(self._rows(queries), self.settings.get("probes", 1))

    def _work(self, k: int):
        return knn.unit_top(k)


class InvertedFile(FlatIndex):
    """Rows by the nearest of ``lists`` centres; a query probes the cells of its nearest centres.

    ``probes`` is their least number; training raises it until ``recall`` of the ten nearest
    of sampled rows are found among the sample. With ``recall`` None it stays as given.
    """

    kind = "IVFFlat"

    def __init__(self, spark, path: str, lists: int = 100, probes: int = 10, recall: float | None = 0.95, **settings):
        super().__init__(spark, path, lists=lists, probes=probes, recall=recall, **settings)

    def _fit(self, x: np.ndarray) -> None:
        self.centres = kmeans(x, self.settings["lists"])
        if self.settings["recall"] is not None:
            self.settings["probes"] = max(self.settings["probes"], enough_probes(x, self.centres, self.settings["recall"]))

    def _cells(self, df: DataFrame, probes: int) -> DataFrame:
        if self.centres is None:
            raise ValueError("the index isn't trained")
        centres, norms = self.centres, (self.centres**2).sum(1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), 1024):
                    part = b.iloc[i : i + 1024]
                    x = np.stack(part["v"].to_numpy())
                    at = np.argsort(norms[None, :] - 2 * x @ centres.T, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), at.shape[1]), "cell": at.ravel(), "v": list(np.repeat(x, at.shape[1], axis=0))})

        return df.select("id", "v").mapInPandas(run, ROW)


def _kinds() -> dict:
    from .graph_index import GraphIndex

    return {"Flat": FlatIndex, "IVF": InvertedFile, "IVFFlat": InvertedFile, "HNSW": GraphIndex}


def index(kind: str, spark: SparkSession, path: str | None = None, **settings) -> VectorIndex:
    """A new index: 'Flat' (exact), 'IVF' or 'IVFFlat' (inverted lists), 'HNSW' (layered graphs). Without a path it is in the shared scratch folder."""
    if kind not in _kinds():
        raise ValueError(f"unknown index type {kind}")
    return _kinds()[kind](spark, path or f"{scratch(spark)}/index", **settings)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was written before."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy("cell").collect()  # a row for each cell
    said = json.loads(rows[0]["settings"])
    kind, dim = said.pop("kind"), said.pop("dim")
    found = _kinds()[kind](spark, path, **said)
    if rows[0]["centre"] is not None:
        found.centres = np.array([r["centre"] for r in rows]).reshape(-1, dim)
    return found
