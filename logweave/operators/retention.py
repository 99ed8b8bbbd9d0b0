"""Retention of files, snapshots and bundles as relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import held
from .running import positions, running


def glob_pattern(glob: str) -> str:
    """A glob of *, ? and literal characters as an anchored regex."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def included(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path fits any include glob (all, if none are given) and no exclude glob."""
    hit = lambda globs: F.greatest(*[path.rlike(glob_pattern(g)) for g in globs]) if len(globs) > 1 else path.rlike(glob_pattern(globs[0]))
    ok = hit(include) if include else F.lit(True)
    return ok & ~hit(exclude) if exclude else ok


def over_age(age_days: Column, most: float) -> Column:
    return age_days > most


def over_size(size: Column, most: int) -> Column:
    return size > most


def any_of(*criteria: Column) -> Column:
    out = F.lit(False)
    for c in criteria:
        out = out | c
    return out


def all_of(*criteria: Column) -> Column:
    out = F.lit(True)
    for c in criteria:
        out = out & c
    return out


def decisions(files: DataFrame, max_age_days: float | None = None, max_total: int | None = None, by: str | None = None) -> DataFrame:
    """Adds delete and reasons: the oldest go while too old or while the rest is too large.

    ``files`` has path, age_days and size_bytes. Deletions are a prefix of the files by
    age, so what is left at a file is the running sum from the youngest up to it; of
    equal age the one with the smaller path goes first. With ``by`` each of its values is a directory
    of its own. Files are dealt out by age, so a directory may have any number of them.
    """
    df = running(files, [F.asc("age_days"), F.desc("path")], by, __left=("sum", F.coalesce("size_bytes", F.lit(0))))
    reasons = F.array_compact(
        F.array(
            F.when(over_age(F.col("age_days"), max_age_days), "age") if max_age_days is not None else F.lit(None).cast("string"),
            F.when(F.col("__left") > max_total, "size") if max_total is not None else F.lit(None).cast("string"),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("delete", F.size("reasons") > 0).drop("__left")


@dataclass(frozen=True)
class Criterion:
    """Why files go: a name, which stands in the reasons, and a condition on a file's columns. Build others of it by ``any_of`` and ``all_of``."""

    name: str
    holds: Column


def judged(files: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Adds delete and reasons, by criteria of one's own; a condition that is null doesn't hold."""
    reasons = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(c.holds, c.name) for c in criteria]))
    return files.withColumn("reasons", reasons).withColumn("delete", F.size("reasons") > 0)


#: An observer takes the events of a run: (event, path, size_bytes, reasons, error).
Observer = Callable[[DataFrame], None]


def carried_out(decided: DataFrame, remove: Callable[[str], None], observers: dict[str, Observer] | None = None, dry_run: bool = False) -> DataFrame:
    """(event, path, size_bytes, reasons, error): what became of each file: deleted, failed or kept; in a dry run planned or kept.

    Tasks call ``remove`` with each path; what it raises is that file's error. The events are computed once, and every observer gets them;
    an observer that fails is an event itself ('observer failed', its name as path) and disturbs neither the others nor the run.
    """
    own = decided.select("path", F.col("size_bytes").cast("long").alias("size_bytes"), "reasons", "delete")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, errors = [], []
            for path, go in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                event, error = ("planned" if dry_run else "deleted") if go else "kept", None
                if event == "deleted":
                    try:
                        remove(path)
                    except Exception as e:  # any failure is a result of its file
                        event, error = "failed", f"{type(e).__name__}: {e}"
                said.append(event)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), *b.columns[:3], pa.array(errors, pa.string())], names=["event", "path", "size_bytes", "reasons", "error"])

    events = held(own.mapInArrow(run, "event string, path string, size_bytes long, reasons array<string>, error string"))
    problems = []
    for name, observer in (observers or {}).items():
        try:
            observer(events)
        except Exception as e:
            problems.append(("observer failed", name, None, None, f"{type(e).__name__}: {e}"))
    return events.unionAll(decided.sparkSession.createDataFrame(problems, events.schema)) if problems else events


def directory_stats(files: DataFrame, by: str | None = None) -> DataFrame:
    g = files.groupBy(by) if by else files.groupBy()
    return g.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.max("age_days").alias("oldest_days"), F.min("age_days").alias("newest_days")
    )


def keep_newest(snapshots: DataFrame, n: int, by: str | None = None, order: str = "created_at", tie: str = "id") -> DataFrame:
    """Adds keep: whether a snapshot is among the newest ``n`` (of its ``by``)."""
    ranked = positions(snapshots, [F.desc(order), F.asc(tie)], by, "__rank")
    return ranked.withColumn("keep", F.col("__rank") <= n).drop("__rank")


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): manifest entries that are missing or have another checksum."""
    j = manifest.select("path", F.col("checksum").alias("__want")).join(found.select("path", F.col("checksum").alias("__got")), "path", "left")
    problem = F.when(F.col("__got").isNull(), "missing").when(F.col("__got") != F.col("__want"), "checksum mismatch")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def manifest_of(files: DataFrame) -> DataFrame:
    """(path, size, checksum) of a binaryFile read."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))
