"""Mixing sources to target weights by Poisson replication.

A source's target share of the mixture over its share of the rows is the mean
number of copies of each of its documents. Each document's number of copies is
drawn from a Poisson distribution of that mean by inverting it at a number in
[0, 1) that a keyed hash of the document gives, so the draw is the same on
every machine and in every run. Documents are exploded by their count and
dealt out anew by a second hash, by which each partition is sorted: a global
shuffle without a global sort. Means over ``PART`` are drawn as sums of several
draws of equal mean, which have the same distribution and don't underflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PART = 16.0
#: Past this many copies a draw of mean PART or less has under 1e-17 of its mass.
TERMS = 80


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons: 52 of its bits."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson distribution, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", power: float = 0.5, total: float = 1.0) -> DataFrame:
    """(source, n, rate): the mean copies of a document of each source.

    ``weights``: target shares by source (normalised; a source not named has none).
    Without them the share of a source goes as its rows to the ``power``. The
    mixture is expected to have ``total`` times the rows of ``docs``. A null source
    is a source of its own, named by '' in ``weights``.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        w = F.lit(0.0)
        for name, share in sorted(weights.items()):
            w = F.when(F.coalesce("source", F.lit("")) == name, float(share)).otherwise(w)
        sizes = sizes.withColumn("w", w)
    sums = sizes.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    # One row beside one row for each source.
    return sizes.join(F.broadcast(sums), F.lit(True)).select(
        "source", "n",
        F.coalesce(F.try_divide(F.lit(float(total)) * F.col("w") * F.col("all_n"), F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate"),
    )


def copies(rate: Column, table: Column, key: Column, seed: int) -> Column:
    """The Poisson draw of one document, inverted from its hash."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")

    def drawn(u: Column) -> Column:
        # Bound by a transform of one element, so that it is hashed once and not for each term.
        return F.transform(F.array(u), lambda x: F.size(F.filter(table, lambda p: p <= x)).cast("long"))[0]

    return F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0).cast("long"),
        lambda acc, i: acc + drawn(uniform(F.lit(seed), key, i)),
    )


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    power: float = 0.5,
    total: float = 1.0,
    seed: int = 17,
    details: bool = False,
) -> DataFrame:
    """The mixture: the rows of ``docs``, each as often as it was drawn, in shuffled order.

    With ``details``, also ``copy`` (from 1) and ``place`` (in [0, 1), the order of the
    shuffle), in place of columns of these names. Rows with equal ids are drawn alike; a null id is drawn as the
    empty string; a null source is a source of its own; other columns pass
    through untouched. An empty table gives an empty one.
    """
    p = common.prefix(docs)
    by = rates(docs, weights, source_col, power, total).select(
        F.col("source").alias(f"{p}source"),
        F.col("rate").alias(f"{p}rate"),
        _cumulative(F.col("rate") / F.greatest(F.ceil(F.col("rate") / PART), F.lit(1))).alias(f"{p}table"),
    )
    # Written first, so that the planner knows its size before it deals out the documents' join.
    by = common.durable(by, "rates")
    drawn = docs.join(by, F.col(source_col).eqNullSafe(F.col(f"{p}source"))).withColumn(
        f"{p}n", copies(F.col(f"{p}rate"), F.col(f"{p}table"), F.col(id_col), seed)
    )
    spread = drawn.where(f"{p}n > 0").select(
        *docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}n"))).alias(f"{p}copy")
    )
    placed = spread.withColumn(f"{p}place", uniform(F.lit(f"{seed}-place"), F.col(id_col), F.col(f"{p}copy")))
    out = placed.repartition(f"{p}place").sortWithinPartitions(f"{p}place")
    if not details:
        return out.select(*docs.columns)
    kept = [c for c in docs.columns if c.lower() not in ("copy", "place")]
    return out.select(*kept, F.col(f"{p}copy").alias("copy"), F.col(f"{p}place").alias("place"))


#: op9 in SQL.
ORACLE = f"""
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
sums AS (SELECT sum(w) AS all_w, sum(n) AS all_n FROM sizes),
rates AS (SELECT source, 1.0::DOUBLE * w * all_n / (all_w * n) AS rate FROM sizes, sums),
parts AS (SELECT source, rate, greatest(ceil(rate / {PART}), 1)::BIGINT AS k FROM rates),
terms AS (
  SELECT source, i, exp(-rate / k) AS first,
         CASE WHEN i = 0 THEN exp(-rate / k) ELSE exp(-rate / k + i * ln(rate / k) - lgamma(i + 1)) END AS term
  FROM parts, (SELECT unnest(range(0, {TERMS + 1})) AS i)
),
tables AS (SELECT source, i, sum(term) OVER (PARTITION BY source ORDER BY i) AS p FROM terms),
draws AS (
  SELECT d.doc_id, d.source, d.n_chars, d.text, j,
         ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(1, r.k + 1)) AS x(j)
),
counted AS (
  SELECT d.doc_id, d.source, d.n_chars, d.text, sum((SELECT count(*) FROM tables t WHERE t.source IS NOT DISTINCT FROM d.source AND t.p <= d.u)) AS n
  FROM draws d GROUP BY d.doc_id, d.source, d.n_chars, d.text
),
copies AS (SELECT c.doc_id, c.source, c.n_chars, c.text, x.copy FROM counted c, unnest(range(1, c.n::BIGINT + 1)) AS x(copy))
SELECT doc_id, source, n_chars, md5(coalesce(text, '')) AS text_md5, copy,
       ('0x' || substr(md5('17-place:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS place
FROM copies
"""
