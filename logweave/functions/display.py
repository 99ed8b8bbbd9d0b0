"""Text shown to people: durations, rates, score bars, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, rounded by its exact binary value, ties to the even digit.

    The number is split into halves of its bits, so that its distance from the midpoint is exact.
    """
    scale = float(10**digits)
    below = F.floor(x * scale)
    wide = x * 134217729.0
    high = wide - (wide - x)
    over = (2 * scale * high - (2 * below + 1)) + 2 * scale * (x - high)
    up = ((over > 0) | ((over == 0) & (below % 2 == 1))).cast("int")
    return F.format_string(f"%.{digits}f", (below + up) / scale)


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 1, F.concat(fixed(seconds * 1000, 0), F.lit("ms"))).when(seconds < 60, F.concat(fixed(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.concat(minutes.cast("string"), F.lit("m "), fixed(seconds - minutes * 60, 0), F.lit("s")))
        .otherwise(F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor((seconds - F.floor(seconds / 3600) * 3600) / 60)))
    )


def rate(per_second: Column, unit: str = "items") -> Column:
    return (
        F.when(per_second >= 1e6, F.concat(fixed(per_second / 1e6, 1), F.lit(f"M {unit}/s")))
        .when(per_second >= 1e3, F.concat(fixed(per_second / 1e3, 1), F.lit(f"K {unit}/s")))
        .when(per_second >= 1, F.concat(fixed(per_second, 1), F.lit(f" {unit}/s"))).otherwise(F.concat(fixed(per_second * 60, 1), F.lit(f" {unit}/min")))
    )


def score_bar(score: Column, width: int = 20) -> Column:
    filled = F.floor(score * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled), F.lit("]"))


def novelty_colour(score: Column) -> Column:
    """The theme slot of a novelty score."""
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("info")
