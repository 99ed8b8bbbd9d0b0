"""Novelty by density: how much sparser the neighbourhood of a row is than the baseline's.

Fit: each baseline row's mean distance to its k nearest others gives a density
1 / (mean + 1e-10); their mean and population deviation are the baseline. Score:
z of a row's own density (or distance) against the baseline, through a
sigmoid. A row that is part of the baseline sees itself at distance zero, as in
the contract. The baseline is one row of numbers; only it meets every scored row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import knn
from .running import running

TINY = 1e-10


@dataclass(frozen=True)
class Baseline:
    """What a fit learned; ``mean`` and ``std`` are of densities or of distances."""

    k: int
    rows: int
    mean: float
    std: float
    density: bool


def neighbour_means(queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool, distinct: bool = False, **names) -> DataFrame:
    """(id, mean_distance): the mean Euclidean distance to the k nearest rows; 0 without neighbours.

    ``distinct`` gives the same with the work of the distinct vectors only, for tables where many are equal; ids are unique then.
    """
    id_col = names.get("id_col", "vec_id")
    if distinct:
        vector_col = names.get("vector_col", "embedding")
        q, r = (
            df.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).groupBy(F.col(vector_col).cast("array<double>").alias("v"))
            .agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count("*").alias("times")) for df in (queries, reference)
        )
        near = knn.nearest(q, r, k + exclude_self, "id", "v")
        means = knn.counted(near, r.select("id", "times"), k, exclude_self).groupBy("query_id").agg((F.sum(F.col("n") * F.sqrt("d2")) / F.sum("n")).alias("mean_distance"))
        of = q.join(means, q["id"] == means["query_id"]).select("v", "mean_distance")
        ids = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("u"))
        return ids.join(of, F.col("u") == F.col("v"), "left").select("id", F.coalesce("mean_distance", F.lit(0.0)).alias("mean_distance"))
    near = knn.nearest(queries, reference, k, exclude_self=exclude_self, **names)
    means = near.groupBy("query_id").agg(F.avg(F.sqrt("d2")).alias("mean_distance"))
    ids = queries.select(F.col(id_col).cast("long").alias("id"))
    return ids.join(means, ids["id"] == means["query_id"], "left").select("id", F.coalesce("mean_distance", F.lit(0.0)).alias("mean_distance"))


def density(mean_distance: Column) -> Column:
    return 1 / (mean_distance + F.lit(TINY))


def baseline_rows(reference: DataFrame, k: int = 5, **names) -> DataFrame:
    """(id, mean_distance, density) of the baseline's own rows, each without itself."""
    rows = neighbour_means(reference, reference, k, exclude_self=True, **names)
    return rows.withColumn("density", density(F.col("mean_distance")))


def fit(reference: DataFrame, k: int = 5, use_density: bool = True, **names) -> Baseline:
    """Collects one row of sums. A deviation under 1e-10 counts as 1; an empty baseline has mean 0."""
    what = "density" if use_density else "mean_distance"
    r = baseline_rows(reference, k, **names).agg(F.count("*"), F.avg(what), F.stddev_pop(what)).first()
    n, mean, std = r[0], r[1] or 0.0, r[2] or 0.0
    return Baseline(k, n, mean, std if std >= TINY else 1.0, use_density)


def score(queries: DataFrame, reference: DataFrame, base: Baseline, **names) -> DataFrame:
    """(id, mean_distance, score in [0, 1]); higher is more novel."""
    rows = neighbour_means(queries, reference, base.k, exclude_self=False, **names)
    what = density(F.col("mean_distance")) if base.density else F.col("mean_distance")
    z = (what - base.mean) / base.std
    raw = 1 / (1 + F.exp(F.greatest(F.least(z if base.density else -z, F.lit(700.0)), F.lit(-700.0))))
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def detect(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds is_novel (at or over the threshold) and an explanation of novel rows."""
    novel = F.col("score") >= threshold
    return scored.withColumn("is_novel", novel).withColumn("explanation", F.when(novel, explanation(F.col("score"), threshold)))


def explanation(score_col: Column, threshold: float) -> Column:
    # The bands and the text.
    band = (
        F.when(score_col >= 0.9, "highly unusual").when(score_col >= 0.8, "unusual").when(score_col >= 0.7, "moderately unusual")
        .otherwise("slightly unusual")
    )
    said = "This log pattern is %s (score: %.3f, threshold: %.3f, margin: %.3f). It appears in a low-density region of the embedding space, indicating deviation from established patterns."
    return F.format_string(said, band, score_col, F.lit(float(threshold)), score_col - F.lit(float(threshold)))


def stats(detected: DataFrame) -> DataFrame:
    """One row of batch statistics."""
    return detected.agg(
        F.count("*").alias("n_samples"), F.count_if("is_novel").alias("n_novel"), F.count_if(~F.col("is_novel")).alias("n_normal"),
        F.round(F.avg(F.col("is_novel").cast("double")), 4).alias("novelty_rate"), F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.stddev_pop("score"), 4).alias("std_score"), F.round(F.min("score"), 4).alias("min_score"), F.round(F.max("score"), 4).alias("max_score"),
    )


def mock_score(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): norms scaled to [0, 1] over the batch, 0.5 if all are equal. Two sums meet each row; no window over all."""
    from ..functions.vectors import norm

    n = rows.select(F.col(id_col).alias("id"), norm(F.col(vector_col)).alias("norm"))
    low, high = n.agg(F.min("norm"), F.max("norm")).first()
    if low is None or high == low:
        return n.select("id", F.lit(0.5).alias("score"))
    return n.select("id", ((F.col("norm") - low) / (high - low)).alias("score"))


def running_stats(scores: DataFrame, order_col: str, score_col: str = "score", by: str | None = None) -> DataFrame:
    """Running mean, largest and smallest score in order, within each value of ``by``."""
    s = F.col(score_col)
    done = running(
        scores, [F.col(order_col)], by, running_max=("max", s), running_min=("min", s),
        __total=("sum", F.coalesce(s, F.lit(0)).cast("double")), __seen=("sum", s.isNotNull().cast("long")),
    )
    return done.withColumn("running_mean", F.try_divide("__total", "__seen")).select(*scores.columns, "running_mean", "running_max", "running_min")
