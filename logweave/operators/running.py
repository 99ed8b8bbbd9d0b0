"""Positions and running aggregates over an order, without a window that one task holds.

Rows are dealt out by ranges of the order, so a group of any size falls to many
tasks; each aggregates its range, and what the ranges before it add up to is joined to it:
one row for each range and group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import held

#: How a running aggregate of a range meets that of the ranges before it.
MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}


def running(df: DataFrame, order: list[Column], by: str | None = None, **aggregates: tuple[str, Column]) -> DataFrame:
    """Adds running aggregates up to each row, itself included, in ``order`` (which should tell all rows apart), within each ``by``.

    An aggregate is a name and (kind, column), its kind one of ``MERGE``. Null values of ``by`` are a group.
    """
    group = [F.col(by)] if by else []
    dealt = held(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = dealt.groupBy("__part", *group).agg(*[getattr(F, kind)(column).alias(f"__{name}") for name, (kind, column) in aggregates.items()])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.select(
        F.col("__part").alias("__at"), *[g.alias("__by") for g in group],
        *[getattr(F, kind)(f"__{name}").over(earlier).alias(f"__{name}") for name, (kind, _) in aggregates.items()],
    )
    local = dealt.withColumns({name: getattr(F, kind)(column).over(within) for name, (kind, column) in aggregates.items()})
    same = F.col("__part") == F.col("__at")
    if by:
        same &= F.col(by).eqNullSafe(F.col("__by"))
    met = local.join(ahead, same, "left")
    return met.withColumns({name: MERGE[kind](F.col(f"__{name}"), F.col(name)) for name, (kind, _) in aggregates.items()}).select(
        *df.columns, *[name for name in aggregates if name not in df.columns]
    )


def positions(df: DataFrame, order: list[Column], by: str | None = None, name: str = "position") -> DataFrame:
    """Adds the position of each row in ``order``, from 1, within each ``by``."""
    return running(df, order, by, **{name: ("sum", F.lit(1).cast("long"))})


def at_shares(samples: DataFrame, by: str, value: str, **at: Callable[[Column], list[Column]]) -> DataFrame:
    """(by, a column for each of ``at``): the mean of the sorted values at positions (from 1) that a function of the group's size names.

    Equal values are counted first, so a value that a third of the samples have is one row. Null values don't count.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    run = running(counts, [F.col("__v")], "__g", __upto=("sum", F.col("__c")))
    sizes = counts.groupBy(F.col("__g").alias("__h")).agg(F.sum("__c").alias("__n"))
    run = run.join(sizes, F.col("__g").eqNullSafe(F.col("__h")))
    picked = []
    for name, places in at.items():
        parts = [F.max(F.when((F.col("__upto") >= p) & (F.col("__upto") - F.col("__c") < p), F.col("__v"))) for p in places(F.col("__n"))]
        picked.append((sum(parts[1:], parts[0]) / len(parts) if len(parts) > 1 else parts[0]).alias(name))
    return run.groupBy(F.col("__g").alias(by)).agg(*picked)
