"""Agreement of labellings, regression against golden data, ablation, trends."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import at_shares, positions

# Labels of a pair, and what kappa is called.
PAIR_LABELS = ["same", "different", "similar", "unsure", "skip"]
KAPPA_BANDS = [
    (0.81, "Almost perfect agreement"), (0.61, "Substantial agreement"), (0.41, "Moderate agreement"), (0.21, "Fair agreement"),
    (0.0, "Slight agreement"), (None, "Poor agreement (less than chance)"),
]


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, expected, kappa): one row. 0 for no rows; certain agreement by chance is 1 if it is real, else 0.

    One pass: cells of the two labels, then sums over their table.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.lit("a").alias("side"), F.col("a").cast("string").alias("label"), "n", (F.col("a") == F.col("b")).alias("same")).unionAll(
        cells.select(F.lit("b"), F.col("b").cast("string"), "n", (F.col("a") == F.col("b")))
    )
    by = sides.groupBy("label").agg(
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("nb"),
        F.sum(F.when((F.col("side") == "a") & F.col("same"), F.col("n")).otherwise(0)).alias("hit"),
    )
    sums = by.agg(F.coalesce(F.sum("na"), F.lit(0)).alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"))
    po, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(F.col("n") == 0, 0.0).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return sums.select("n", F.when(F.col("n") > 0, po).otherwise(0.0).alias("agreement"), F.when(F.col("n") > 0, pe).otherwise(0.0).alias("expected"), kappa.alias("kappa"))


def contingency_scores(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """(n, ari, nmi, accuracy): one row, over rows whose labels are both at least 0; fewer than two give 0.

    ARI from pair counts, NMI by the arithmetic mean; sums over the table of label pairs.
    """
    rows = df.where((F.col(expected) >= 0) & (F.col(actual) >= 0))
    cells = rows.groupBy(F.col(expected).alias("e"), F.col(actual).alias("a")).agg(F.count("*").cast("double").alias("n"))
    by_e = cells.groupBy("e").agg(F.sum("n").alias("ne"))
    by_a = cells.groupBy("a").agg(F.sum("n").alias("na"))
    pairs = lambda n: n * (n - 1) / 2
    total = cells.agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("both"), F.sum(F.when(F.col("e") == F.col("a"), F.col("n")).otherwise(0.0)).alias("hit"))
    plogp = lambda n: n * F.log(n)
    sums = (
        total.crossJoin(by_e.agg(F.sum(pairs(F.col("ne"))).alias("pe"), F.sum(plogp(F.col("ne"))).alias("he"), F.count("*").alias("ke")))
        .crossJoin(by_a.agg(F.sum(pairs(F.col("na"))).alias("pa"), F.sum(plogp(F.col("na"))).alias("ha"), F.count("*").alias("ka")))
        .crossJoin(cells.agg(F.sum(plogp(F.col("n"))).alias("hc")))
    )  # every side is one row
    n = F.col("n")
    tp, fp, fn = F.col("both"), F.col("pa") - F.col("both"), F.col("pe") - F.col("both")
    tn = pairs(n) - tp - fp - fn
    ari = F.when((fp == 0) & (fn == 0), 1.0).otherwise(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    h = lambda c: F.log(n) - F.col(c) / n
    mi = h("he") + h("ha") - h("hc")
    nmi = F.when((F.col("ke") == 1) & (F.col("ka") == 1), 1.0).when(mi <= 1e-15, 0.0).otherwise(mi / ((h("he") + h("ha")) / 2))
    some = F.coalesce(n, F.lit(0.0)) >= 2
    return sums.select(
        F.coalesce(n, F.lit(0.0)).cast("long").alias("n"), F.when(some, ari).otherwise(0.0).alias("ari"), F.when(some, nmi).otherwise(0.0).alias("nmi"),
        F.when(n > 0, F.col("hit") / n).otherwise(0.0).alias("accuracy"),
    )


def regression_status(ari: Column, worse: Column | None = None, threshold: float = 0.7, tolerance: float = 0.1) -> Column:
    """FAILED, DEGRADED, IMPROVED or PASSED; ``worse``: whether any quality metric is beyond its threshold."""
    return (
        F.when(ari < threshold - tolerance, "FAILED").when(ari < threshold, "DEGRADED")
        .when(F.lit(False) if worse is None else worse, "DEGRADED").when(ari > threshold + tolerance, "IMPROVED").otherwise("PASSED")
    )


def label_distribution(df: DataFrame, label_col: str, labels: list[str] = PAIR_LABELS) -> DataFrame:
    """(label, n) for every label of the list, 0 where there is none."""
    spark = df.sparkSession
    named = spark.createDataFrame([(x,) for x in labels], "label string")
    seen = df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    return named.join(seen, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def cluster_pairs(clusters: DataFrame, id_col: str, n_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """(pair_id, a, b): pairs of different clusters, the smaller first; ``n_pairs`` of them by keyed hash."""
    a, b = clusters.select(F.col(id_col).alias("a")), clusters.select(F.col(id_col).alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("pair_id", F.concat_ws("-", "a", "b"))
    if n_pairs is None:
        return pairs.select("pair_id", "a", "b")
    return pairs.orderBy(F.xxhash64("pair_id", F.lit(seed)), "pair_id").limit(n_pairs).select("pair_id", "a", "b")


def set_changes(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, change): 'new' for keys only in ``actual``, 'missing' for those only in ``expected``."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(e, key, "left_anti").withColumn("change", F.lit("new")).unionAll(e.join(a, key, "left_anti").withColumn("change", F.lit("missing")))


def trends(history: DataFrame, metric: str = "metric", value: str = "value", order: str = "ts", band: float = 0.05) -> DataFrame:
    """Adds previous, change and direction; ``higher_is_better`` is a column of ``history``.

    Within the band it is stable; without a previous value, or with NaN, unknown.
    """
    w = Window.partitionBy(metric).orderBy(order)
    df = history.withColumn("previous", F.lag(value).over(w))
    change = F.when(F.col("previous") == 0, 0.0).otherwise((F.col(value) - F.col("previous")) / F.abs("previous"))
    bad = F.col("previous").isNull() | F.isnan("previous") | F.col(value).isNull() | F.isnan(value)
    better = (F.col("change") > 0) == F.col("higher_is_better")
    return df.withColumn("change", F.when(~bad, change)).withColumn(
        "direction", F.when(bad, "unknown").when(F.abs("change") < band, "stable").when(better, "improving").otherwise("degrading")
    )


def latest(history: DataFrame, n: int, order: str = "ts", by: str = "metric") -> DataFrame:
    """The last ``n`` rows of each metric."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return history.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def ablation_summary(runs: DataFrame, config: str = "config", quality: str = "quality") -> DataFrame:
    """(config, n_runs, mean_quality, is_best): the best has the highest mean, of equals the first name."""
    by = runs.groupBy(config).agg(F.count("*").alias("n_runs"), F.avg(quality).alias("mean_quality"))
    best = by.agg(F.max_by(config, F.struct("mean_quality")).alias("best"), F.max("mean_quality").alias("top"))
    first = by.join(best, F.col("mean_quality") == F.col("top")).agg(F.min(config).alias("best"))
    return by.join(first, by[config] == first["best"], "left").select(config, "n_runs", "mean_quality", F.col("best").isNotNull().alias("is_best"))


def student_t_two_sided(t: float, df: float) -> float:
    """The two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    value = front * h / a
    return 1 - value if flip else value


def ablation_compare(runs: DataFrame, config: str = "config", quality: str = "quality", least: int = 3) -> DataFrame:
    """(a, b, difference, winner, t, p_value) for every pair of configs, by Student's test with equal variances.

    A wins only if it is better; p is null with fewer than ``least`` runs of either.
    One row for each config meets every other; the p-value is the only Python here.
    """

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_t_two_sided(x, d) if pd.notna(x) and pd.notna(d) else None for x, d in zip(t, df)], dtype="float64")

    by = runs.groupBy(F.col(config).alias("c")).agg(F.avg(quality).alias("m"), F.var_samp(quality).alias("v"), F.count("*").alias("n"))
    a, b = (by.select(*[F.col(x).alias(x + s) for x in by.columns]) for s in "ab")
    pairs = a.join(b, F.col("ca") < F.col("cb"))
    free = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / free
    enough = (F.col("na") >= least) & (F.col("nb") >= least) & (pooled > 0)
    t = F.when(enough, (F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb"))))
    diff = F.col("ma") - F.col("mb")
    return pairs.select(
        F.col("ca").alias("a"), F.col("cb").alias("b"), diff.alias("difference"), F.when(diff > 0, F.col("ca")).otherwise(F.col("cb")).alias("winner"),
        t.alias("t"), p_value(t, F.when(enough, free).cast("double")).alias("p_value"),
    )


def percentile_by_index(samples: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """The value at index min(floor(n * q), n - 1) of the sorted samples, not interpolated."""
    return at_shares(samples, by, value, **{name: _index(q)})


def _index(q: float):
    return lambda n: [F.least(F.floor(n * q), n - 1) + 1]


def timing_stats(samples: DataFrame, by: str = "name", value: str = "sample") -> DataFrame:
    """count, sum, mean, median, sample deviation (0 for one sample), min, max, p95, p99 by name."""
    base = samples.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
        F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("stdev"), F.min(value).alias("least"), F.max(value).alias("most"),
    )
    middle = lambda n: [F.floor((n + 1) / 2), F.floor(n / 2) + 1]
    at = at_shares(samples, by, value, median=middle, p95=_index(0.95), p99=_index(0.99))
    return base.join(at, by).select(by, "n", "total", "mean", "median", "stdev", "least", "most", "p95", "p99")


def throughput(items: Column, nbytes: Column, seconds: Column) -> Column:
    """A struct of rates; all 0 where the duration isn't positive."""
    rate = lambda x: F.when(seconds > 0, x / seconds).otherwise(0.0)
    return F.struct(rate(items).alias("items_per_second"), rate(nbytes).alias("bytes_per_second"), rate(nbytes / 1048576).alias("mb_per_second"))


def sweep(parameter: str, values: list, baseline) -> list[dict]:
    """Configurations of a parameter sweep, the baseline first; each is named by its value."""
    named = [{"config": f"{parameter}={baseline} (baseline)", parameter: baseline}]
    return named + [{"config": f"{parameter}={v}", parameter: v} for v in values if v != baseline]


def run_ablation(data: DataFrame, configs: list[dict], measure, n_runs: int = 3, seed: int = 42) -> DataFrame:
    """(config, run, quality): ``measure(data, config, seed)`` is a one-row frame with ``quality``; every run is a plan, all run as one job."""
    out = None
    for c in configs:
        for run in range(n_runs):
            one = measure(data, c, seed + run).select(F.lit(c["config"]).alias("config"), F.lit(run).alias("run"), F.col("quality").cast("double").alias("quality"))
            out = one if out is None else out.unionAll(one)
    return out


def session_order(pairs: DataFrame, session: str, pair_id: str = "pair_id", seed: int = 42) -> DataFrame:
    """Adds position (from 1): the order in which a session shows its pairs, by keyed hash."""
    return positions(pairs, [F.xxhash64(F.lit(f"{session}-{seed}"), F.col(pair_id)), F.col(pair_id)])


def session_progress(pairs: DataFrame, labels: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """(total, labelled, skipped, remaining, percent): one row."""
    j = pairs.select(pair_id).join(labels.select(pair_id, "label"), pair_id, "left")
    total, done = F.count("*"), F.count("label")
    return j.agg(
        total.alias("total"), done.alias("labelled"), F.count_if(F.col("label") == "skip").alias("skipped"), (total - done).alias("remaining"),
        F.round(100 * done / total, 2).alias("percent"),
    )
