"""Versions: parsing, ordering, compatibility and migration paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def parse(text: Column) -> Column:
    """A struct (major, minor, patch, prerelease, build); null if it isn't a version."""
    part = lambda i: F.regexp_extract(F.trim(text), SEMVER, i)
    return F.when(
        F.trim(text).rlike(SEMVER),
        F.struct(
            *[part(i).try_cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))],
            F.nullif(part(4), F.lit("")).alias("prerelease"), F.nullif(part(5), F.lit("")).alias("build"),
        ),
    )


def bump(v: Column, part: str) -> Column:
    """The next version as text; 'major', 'minor' or 'patch'. A prerelease is dropped."""
    up = {"major": (1, None, None), "minor": (0, 1, None), "patch": (0, 0, 1)}[part]
    numbers = [F.lit(0) if u is None else v[n] + u for u, n in zip(up, ("major", "minor", "patch"))]
    return F.concat_ws(".", *[n.cast("string") for n in numbers])


def sort_key(v: Column) -> Column:
    """A struct that orders versions; a release comes after its prereleases."""
    return F.struct(v["major"], v["minor"], v["patch"], v["prerelease"].isNull(), F.coalesce(v["prerelease"], F.lit("")))


def compatible(v: Column, major: Column) -> Column:
    return v["major"] == major


def migration_path(edges: DataFrame, start: str, goal: str, limit: int = 32) -> DataFrame:
    """(hops, path): the shortest chain of migrations from one version to another.

    ``edges`` has from_version, to_version and migration_id. Breadth first, one
    join for each hop; a version already reached is not entered again, so the
    frontier never exceeds the number of versions. Of equally short chains the first
    by migration ids wins. No row if there is none within ``limit`` hops.
    """
    spark = edges.sparkSession
    empty = F.expr("cast(array() as array<string>)")
    if start == goal:
        return spark.range(1).select(F.lit(0).alias("hops"), empty.alias("path"))
    front = spark.range(1).select(F.lit(start).alias("at"), empty.alias("path"))
    seen = front.select("at")
    for hops in range(1, limit + 1):
        step = (
            front.join(edges, front["at"] == edges["from_version"])
            .select(F.col("to_version").alias("at"), F.concat("path", F.array("migration_id")).alias("path"))
            .join(seen, "at", "left_anti").groupBy("at").agg(F.min("path").alias("path"))
        )
        found = step.collect()  # at most one row for each version
        if not found:
            break
        front = spark.createDataFrame([(r["at"], r["path"]) for r in found], "at string, path array<string>")
        hit = [r for r in found if r["at"] == goal]
        if hit:
            return spark.createDataFrame([(hops, hit[0]["path"])], "hops int, path array<string>")
        seen = seen.unionAll(front.select("at"))
    return spark.createDataFrame([], "hops int, path array<string>")


class Migrator:
    """Applies a chain of migrations to a data folder, undoing what was done if one fails.

    A migration has up(path), down(path) and validate(path); they are plain code on the driver.
    """

    def __init__(self, edges: DataFrame, migrations: dict):
        self.edges, self.migrations = edges, migrations

    def plan(self, start: str, goal: str) -> list[str]:
        found = migration_path(self.edges, start, goal).first()
        if found is None:
            raise ValueError(f"no migrations from {start} to {goal}")
        return list(found["path"])

    def migrate(self, path: str, start: str, goal: str, dry_run: bool = False) -> list[str]:
        """The ids of the migrations applied, or to be applied."""
        ids = self.plan(start, goal)
        if dry_run:
            return ids
        done: list[str] = []
        try:
            for i in ids:
                self.migrations[i].up(path)
                done.append(i)
                if not self.migrations[i].validate(path):
                    raise ValueError(f"migration {i} left the data invalid")
        except Exception:
            self.rollback(path, done)
            raise
        return done

    def rollback(self, path: str, done: list[str]) -> None:
        for i in reversed(done):
            self.migrations[i].down(path)
