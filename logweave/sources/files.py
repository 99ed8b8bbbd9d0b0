"""Batch sources: text files with line numbers, globs, JSON logs, golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The longest line, in characters, that ``read_lines`` takes.
MAX_LINE = 1024 * 1024
PATTERNS = "*.{log,jsonl}"

# The columns of the engines' own JSON log.
LOG_SCHEMA = (
    "timestamp string, level string, service string, hostname string, pid int, msg string, caller string, request_id string, "
    "path string, count int, duration string, error_code string, batch_size int"
)


def read_lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False, numbered: bool = False) -> DataFrame:
    """(line, source[, line_num]) of text files, of all files that fit a glob.

    A line over ``MAX_LINE`` characters is an error when its row is computed, not left out. Files are split and read in parallel, also for numbering, which
    reads them twice: lines are counted for each split, a row for each is summed up within its file, and a line's number is its place in its split
    and what the splits before it hold. Whether the splits' table is broadcast for that or lines are dealt out by split is the planner's choice.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("__block"))
    if not numbered:
        rows = rows.drop("__block")
    else:
        # Rows of a split are read one after the other, so these ids count them without a gap.
        rows = rows.withColumn("__id", F.monotonically_increasing_id())
        splits = rows.groupBy("source", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
        before = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.select("source", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        rows = rows.join(splits, ["source", "__block"]).select("line", "source", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line_num"))
    too_long = F.raise_error(F.concat(F.lit("line too long in "), F.col("source"))).cast("string")
    return rows.withColumn("line", F.when(F.length("line") <= MAX_LINE, F.col("line")).otherwise(too_long))


def discover(spark: SparkSession, path: str, glob: str = PATTERNS, recursive: bool = True, most: int | None = None) -> DataFrame:
    """(path, size, modified) of files that fit, up to a size if one is given; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.lit(True) if most is None else F.col("size") <= most)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The engines' JSON log with its duration in seconds and its date; bad rows are null."""
    df = spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").json(path)
    amount = F.regexp_extract("duration", r"^([0-9.]+)", 1).try_cast("double")
    seconds = F.when(F.col("duration").endswith("ms"), amount / 1000).otherwise(amount)
    ts = F.try_to_timestamp("timestamp")
    return df.withColumns({"seconds": seconds, "ts": ts, "date": F.to_date(ts)})


def read_golden(spark: SparkSession, folder: str, name: str, version: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(records, clusters, version) of a golden set; the latest version by name order unless one is given."""
    files = spark.read.option("multiLine", True).option("pathGlobFilter", f"{name}_v*.json").json(folder).withColumn("__file", F.col("_metadata.file_name"))
    files = files.withColumn("__version", F.regexp_extract("__file", rf"^{name}_v(.+)\.json$", 1))
    chosen = version or files.agg(F.max("__version")).first()[0]
    if chosen is None:
        raise FileNotFoundError(f"no golden set {name} in {folder}")
    one = files.where(F.col("__version") == chosen)
    return one.select(F.explode("records").alias("r")).select("r.*"), one.select(F.explode("expected_clusters").alias("c")).select("c.*"), chosen


def read_demo(spark: SparkSession, path: str) -> DataFrame:
    """Demo lines with their class; the whole line is kept, as its keys vary."""
    from ..operators.detection import demo_class

    lines = spark.read.text(path).select(F.col("value").alias("line"))
    doc = F.try_parse_json("line")
    return lines.where(doc.isNotNull()).select("line", F.try_variant_get(doc, "$.msg", "string").alias("msg"), demo_class(F.try_variant_get(doc, "$.category", "string")).alias("class"))


def open_source(spark: SparkSession, target: str, **options) -> DataFrame:
    """Lines of '-' (standard input, read by the driver), of a folder (all its files) or of a file."""
    if target == "-":
        import sys

        schema = T.StructType([T.StructField("line", T.StringType()), T.StructField("source", T.StringType())])
        return spark.createDataFrame(((line.rstrip("\r\n"), "stdin") for line in sys.stdin), schema)
    return read_lines(spark, target, **options)
