"""Commit messages and changelog files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Conventional commit types and the sections they belong to; others are Changed.
SECTIONS = {
    "feat": "Added", "feature": "Added", "fix": "Fixed", "bugfix": "Fixed", "docs": "Changed", "style": "Changed",
    "refactor": "Changed", "perf": "Changed", "test": "Changed", "chore": "Changed", "build": "Changed", "ci": "Changed",
    "revert": "Removed", "security": "Security", "deprecated": "Deprecated",
}
SECTION_NAMES = ["Added", "Changed", "Deprecated", "Removed", "Fixed", "Security"]
COMMIT = r"^(\w+)(?:\(([^)]+)\))?\s*(!)?\s*:\s*(.+)"
RELEASE = r"^## \[([^\]]+)\](?: - (\d{4}-\d{2}-\d{2}))?( \[YANKED\])?"


def parse_commit(message: Column) -> Column:
    """A struct (entry_type, scope, breaking, description, refs), null if the message has no type."""
    head = F.substring_index(F.trim(message), "\n", 1)
    part = lambda i: F.regexp_extract(head, COMMIT, i)
    kinds = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    return F.when(
        head.rlike(COMMIT),
        F.struct(
            F.coalesce(F.try_element_at(kinds, F.lower(part(1))), F.lit("Changed")).alias("entry_type"),
            F.nullif(part(2), F.lit("")).alias("scope"),
            (part(3) == "!").alias("breaking"),
            F.trim(part(4)).alias("description"),
            F.transform(F.regexp_extract_all(message, F.lit(r"#(\d+)"), F.lit(1)), lambda r: F.concat(F.lit("#"), r)).alias("refs"),
        ),
    )


def parse_changelog(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, pos, release, date, yanked, section, entry): every list entry under a release and section.

    Release and section are carried down a file by last_value; a section ends
    with its release, and an unknown section has no entries. A file is one
    window, so a file must fit a task; files are independent.
    """
    rows = files.select(F.col(path_col).alias("path"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    ahead = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    release = F.when(F.col("line").rlike(RELEASE), F.struct(F.regexp_extract("line", RELEASE, 1).alias("name"), F.nullif(F.regexp_extract("line", RELEASE, 2), F.lit("")).alias("date"), (F.regexp_extract("line", RELEASE, 3) != "").alias("yanked"), F.col("pos").alias("pos")))
    named = F.regexp_extract("line", r"^### (\w+)", 1)
    section = F.when(named != "", F.struct(F.when(named.isin(SECTION_NAMES), named).alias("name"), F.col("pos").alias("pos")))
    filled = rows.withColumns({"r": F.last_value(release, True).over(ahead), "s": F.last_value(section, True).over(ahead)})
    return filled.where(
        F.col("line").rlike(r"^- .+$") & F.col("r").isNotNull() & (F.col("s.pos") > F.col("r.pos")) & F.col("s.name").isNotNull()
    ).select(
        "path", "pos", F.col("r.name").alias("release"), F.col("r.date").alias("date"), F.col("r.yanked").alias("yanked"),
        F.col("s.name").alias("section"), F.trim(F.substring("line", 3, 2**31 - 1)).alias("entry"),
    )


def parse_git_log(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(sha, author, entry_type, scope, breaking, description, refs) of ``%H|%s|%an`` lines whose subject has a type."""
    parts = F.split(F.col(line_col), r"\|")
    rows = lines.where(F.size(parts) >= 3).select(
        parts[0].alias("sha"), F.element_at(parts, -1).alias("author"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "|").alias("subject")
    )
    return rows.withColumn("c", parse_commit(F.col("subject"))).where("c is not null").select("sha", "author", "c.*")
