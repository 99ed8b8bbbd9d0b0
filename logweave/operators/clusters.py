"""Cluster summaries and quality metrics. Label -1 is noise and takes no part."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import knn


def live(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.where(F.col(label_col) >= 0)


def sizes(df: DataFrame, label_col: str = "label") -> DataFrame:
    return live(df, label_col).groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("size"))


def counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(n_clusters, n_noise, n_samples, noise_ratio): one row."""
    label = F.col(label_col)
    return df.agg(
        F.count_distinct(F.when(label >= 0, label)).alias("n_clusters"), F.count_if(label < 0).alias("n_noise"), F.count("*").alias("n_samples"),
        F.round(F.coalesce(F.avg((label < 0).cast("double")), F.lit(0.0)), 4).alias("noise_ratio"),
    )


def centroids(df: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(label, centroid, size): element-wise means, summed map-side by (label, position)."""
    parts = live(df, label_col).select(F.col(label_col).alias("label"), F.posexplode(vector_col).alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("size")
    )


def _with_centroids(df: DataFrame, centres: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    return live(df, label_col).join(centres.select(F.col("label").alias("__label"), "centroid"), F.col(label_col) == F.col("__label"))


def representatives(df: DataFrame, k: int = 5, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(label, rank, id, distance): the ``k`` members nearest to each centroid, ties to the smaller id."""
    near = _with_centroids(df, centroids(df, label_col, vector_col), label_col, vector_col).select(
        F.col(label_col).alias("label"), F.col(id_col).alias("id"), V.l2(F.col(vector_col), F.col("centroid")).alias("distance")
    )
    w = Window.partitionBy("label").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mode(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, mode): the commonest non-null value, of equals the one seen first."""
    seen = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return seen.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias("mode"))


def summaries(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """One row for each cluster: size, centroid, representatives, common level and source, time range.

    ``df`` has level, source and ts; nulls don't count. Ties of the common value go
    to what the smallest id has.
    """
    rows = live(df, label_col)
    base = rows.groupBy(F.col(label_col).alias("label")).agg(
        F.count("*").alias("size"), F.min("ts").alias("time_range_start"), F.max("ts").alias("time_range_end")
    )
    reps = representatives(df, k, id_col, label_col, vector_col).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("representatives")
    )
    named = rows.withColumn("label", F.col(label_col))
    return (
        base.join(centroids(df, label_col, vector_col).select("label", "centroid"), "label").join(reps, "label", "left")
        .join(mode(named, "label", "level", id_col).withColumnRenamed("mode", "common_level"), "label", "left")
        .join(mode(named, "label", "source", id_col).withColumnRenamed("mode", "common_source"), "label", "left")
    )


def mock_labels(df: DataFrame, n: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, label): the first component cut at ``n`` even points from its least to its greatest value."""
    x = df.select(F.col(id_col).alias("id"), F.col(vector_col)[0].cast("double").alias("x"))
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return x.select("id", F.lit(-1).alias("label"))
    step = (high - low) / (n - 1) if n > 1 and high > low else 1.0
    label = F.least(F.greatest(F.floor((F.col("x") - low) / step), F.lit(0)), F.lit(n - 1))
    return x.select("id", label.cast("int").alias("label"))


def silhouette_points(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, s): each point's silhouette by Euclidean distance, 0 alone in its cluster.

    Distances are summed to (point, cluster) within units of two blocks, so the
    quadratic part never leaves numpy; what is shuffled is one row for each
    point, cluster and block.
    """

    def work(q_ids, q_tags, q, ids, tags, c):
        d = np.sqrt(knn.squared_distances(q, c))
        d[q_ids[:, None] == ids[None, :]] = 0.0
        kinds, where = np.unique(tags, return_inverse=True)
        hot = np.zeros((len(tags), len(kinds)))
        hot[np.arange(len(tags)), where] = 1
        return pd.DataFrame(
            {
                "id": np.repeat(q_ids, len(kinds)), "own": np.repeat(q_tags, len(kinds)), "other": np.tile(kinds, len(q_ids)),
                "total": (d @ hot).ravel(), "n": np.tile(hot.sum(0).astype(np.int64), len(q_ids)),
            }
        )

    rows = live(df, label_col)
    sums = knn.by_blocks(
        knn.packed(rows, id_col, vector_col, 1024, label_col, "q_"), knn.packed(rows, id_col, vector_col, knn.BLOCK, label_col), work,
        "id long, own long, other long, total double, n long", lambda sums: sums.groupby(["id", "own", "other"], as_index=False).sum(), whole=True,
    )
    by = sums.groupBy("id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    ab = by.groupBy("id", F.col("own").alias("label")).agg(
        F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    top = F.greatest("a", "b")
    return ab.select("id", "label", F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("s"))


def silhouette(df: DataFrame, **names) -> DataFrame:
    """(silhouette): the mean over points; null with fewer than two clusters."""
    points = silhouette_points(df, **names)
    return points.agg(F.when(F.count_distinct("label") > 1, F.avg("s")).alias("silhouette"))


def davies_bouldin(df: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(davies_bouldin): the mean over clusters of their worst overlap; null with fewer than two clusters."""
    centres = centroids(df, label_col, vector_col)
    scatter = _with_centroids(df, centres, label_col, vector_col).groupBy(F.col(label_col).alias("label")).agg(
        F.avg(V.l2(F.col(vector_col), F.col("centroid"))).alias("s"), F.first("centroid").alias("c")
    )
    a, b = scatter.select(F.col("label").alias("i"), F.col("s").alias("si"), F.col("c").alias("ci")), scatter.select(F.col("label").alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    pairs = a.join(b, F.col("i") != F.col("j"))  # one row for each pair of clusters
    gap = V.l2(F.col("ci"), F.col("cj"))
    worst = pairs.groupBy("i").agg(F.max(F.when(gap > 0, (F.col("si") + F.col("sj")) / gap).otherwise(0.0)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(calinski_harabasz): dispersion between over dispersion within; null with fewer than two clusters."""
    centres = centroids(df, label_col, vector_col)
    whole = centres.select(F.posexplode("centroid").alias("pos", "m"), "size").groupBy("pos").agg((F.sum(F.col("m") * F.col("size")) / F.sum("size")).alias("m"))
    overall = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("o"))
    between = centres.join(F.broadcast(overall), F.lit(True)).agg(  # one vector
        F.sum(F.col("size") * V.squared_l2(F.col("centroid"), F.col("o"))).alias("between"), F.count("*").alias("k"), F.sum("size").alias("n")
    )
    within = _with_centroids(df, centres, label_col, vector_col).agg(F.sum(V.squared_l2(F.col(vector_col), F.col("centroid"))).alias("within"))
    both = between.join(F.broadcast(within), F.lit(True))  # one row each
    ratio = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return both.select(F.when((F.col("k") < 2) | (F.col("n") <= F.col("k")), F.lit(None)).when(F.col("within") == 0, 1.0).otherwise(ratio).alias("calinski_harabasz"))


def overall_quality(silhouette_col: Column, db_col: Column, ch_col: Column) -> Column:
    """The mean of what can be computed, each scaled to [0, 1]; 0 if nothing can."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c)
    parts = F.array_compact(
        F.array(
            F.when(ok(silhouette_col), (silhouette_col + 1) / 2),
            F.when(ok(db_col), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + db_col)))),
            F.when(ok(ch_col) & (ch_col > 0), F.least(F.lit(1.0), F.log10(ch_col + 1) / 3)),
        )
    )
    return F.when(F.size(parts) > 0, V.total(parts) / F.size(parts)).otherwise(0.0)


# What scores are called, best first, with the last for all others.
SILHOUETTE_BANDS = [
    (0.7, "Excellent cluster separation"), (0.5, "Good cluster separation"), (0.25, "Moderate cluster separation"),
    (0.0, "Weak cluster separation, clusters may overlap"), (None, "Poor clustering, samples may be misassigned"),
]
DAVIES_BOULDIN_BANDS = [
    (0.5, "Excellent cluster compactness and separation"), (1.0, "Good cluster quality"), (2.0, "Moderate cluster quality"),
    (None, "Poor cluster quality, consider adjusting parameters"),
]
CALINSKI_HARABASZ_BANDS = [
    (500.0, "Excellent cluster definition"), (200.0, "Good cluster definition"), (50.0, "Moderate cluster definition"),
    (None, "Weak cluster definition"),
]


def band(value: Column, bands: list[tuple[float | None, str]], rising: bool = True) -> Column:
    """The name of the first band whose edge the value reaches; null if it can't be computed."""
    out = F.lit(bands[-1][1])
    for edge, name in reversed(bands[:-1]):
        out = F.when(value >= edge if rising else value <= edge, name).otherwise(out)
    return F.when(value.isNotNull() & ~F.isnan(value), out)


@dataclass(frozen=True)
class Metric:
    """A measure of a clustering: ``compute(df, label_col, vector_col)`` gives one row with one value, ``bands`` say what a value means."""

    name: str
    compute: Callable[[DataFrame, str, str], DataFrame]
    rising: bool = True
    bands: tuple = ((None, "no interpretation"),)


_metrics: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("silhouette", lambda df, label, vector: silhouette(df, label_col=label, vector_col=vector), True, tuple(SILHOUETTE_BANDS)),
        Metric("davies_bouldin", davies_bouldin, False, tuple(DAVIES_BOULDIN_BANDS)),
        Metric("calinski_harabasz", calinski_harabasz, True, tuple(CALINSKI_HARABASZ_BANDS)),
    )
}


def register_metric(metric: Metric) -> None:
    """Makes a metric known by its name; a known one is replaced."""
    _metrics[metric.name] = metric


def metrics() -> list[str]:
    return list(_metrics)


def evaluate(df: DataFrame, names: list[str] | None = None, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(metric, value, better, meaning): one row for each named metric, all by default; null where a metric can't be computed."""
    unknown = set(names or []) - set(_metrics)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    out = None
    for name in metrics() if names is None else names:
        m = _metrics[name]
        one = m.compute(df, label_col, vector_col)
        value = F.col(f"`{one.columns[0]}`").cast("double")
        row = one.select(F.lit(name).alias("metric"), value.alias("value"), F.lit("higher" if m.rising else "lower").alias("better"), band(value, list(m.bands), m.rising).alias("meaning"))
        out = row if out is None else out.unionAll(row)
    if out is None:
        raise ValueError("no metrics")
    return out


def grade(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "acceptable").when(score >= 0.2, "poor").otherwise("very poor")
