"""Session defaults shared by the bench, the tests and interactive use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "logweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes (UTC clock, AQE on)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables under ``sf_dir``; any path Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """Deals the rows of a few files out to all cores, ahead of work that is heavy for each row.

    A table of at least as many files as there are cores is left as it is, so at
    scale nothing is shuffled. Select the columns that are needed first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def _shared(spark) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only a local master may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="logweave-")


def scratch(spark) -> str:
    """A new folder's path under the shared one; it goes when the driver's JVM ends."""
    path = f"{_shared(spark)}/logweave-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def local_path(spark, path: str) -> str:
    """The path on a file system that driver and executors mount, of any form of it; an error for other stores."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if where.getScheme() != "file":
        raise ValueError(f"{path} is not on a file system that executors mount")
    return where.getPath()


def deleted(spark, path: str) -> None:
    """Deletes a folder and what is in it, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def held(df):
    """``df`` computed now, its plan cut, in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()
