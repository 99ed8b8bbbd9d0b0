"""Benchmarks of one's own: set-up, warm-up, timed iterations, tear-down."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import evaluation

SAMPLES = "name string, iteration int, seconds double, items long, error string"


@dataclass
class Benchmark:
    """``run`` gets what ``setup`` returned and may return a frame, which is computed whole, or a number of items."""

    name: str
    run: Callable
    setup: Callable[[SparkSession], object] | None = None
    teardown: Callable[[object], None] | None = None
    warmups: int = 3
    iterations: int = 10

    def samples(self, spark: SparkSession) -> DataFrame:
        """(name, iteration, seconds, items, error): one row for each timed iteration; a failed one has its error and no time."""
        rows, held = [], self.setup(spark) if self.setup else spark
        try:
            for i in range(-self.warmups, self.iterations):
                began, items, error = time.perf_counter(), None, None
                try:
                    out = self.run(held)
                    if isinstance(out, DataFrame):
                        out.write.format("noop").mode("overwrite").save()
                    elif isinstance(out, int):
                        items = out
                except Exception as e:  # a failure is a result of its iteration
                    error = f"{type(e).__name__}: {e}"[:500]
                took = time.perf_counter() - began
                if i >= 0:
                    rows.append((self.name, i, None if error else took, items, error))
        finally:
            if self.teardown:
                self.teardown(held)
        return spark.createDataFrame(rows, SAMPLES)


def suite(spark: SparkSession, benchmarks: list[Benchmark]) -> DataFrame:
    """Timing statistics by benchmark over all its iterations that succeeded."""
    whole = None
    for b in benchmarks:
        one = b.samples(spark)
        whole = one if whole is None else whole.unionAll(one)
    if whole is None:
        raise ValueError("no benchmark given")
    return evaluation.timing_stats(whole.where("seconds is not null"), "name", "seconds")
