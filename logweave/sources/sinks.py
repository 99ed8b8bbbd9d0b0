"""Sinks: JSON logs, snapshots with a manifest, bundles, dry runs, notifications."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retention import manifest_of, verify_manifest


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_log(
    df: DataFrame, path: str, rows_per_file: int = 100_000, backups: int | None = None, max_bytes: int | None = None, max_age_days: float | None = None
) -> list[str]:
    """JSON lines, appended as files of bounded size; the log is rotated afterwards. The files that went.

    The newest ``backups`` files stay, of these as many as fit ``max_bytes`` in all (one at least),
    and of these those up to ``max_age_days`` old. Without limits nothing goes.
    """
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)
    if backups is None and max_bytes is None and max_age_days is None:
        return []
    fs, at = _filesystem(df.sparkSession, path)
    files = [f for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    files.sort(key=lambda f: (-f.getModificationTime(), f.getPath().getName()))
    gone, total, now = [], 0, time.time() * 1000
    for i, f in enumerate(files):
        total += f.getLen()
        old = max_age_days is not None and now - f.getModificationTime() > max_age_days * 86_400_000
        if old or (backups is not None and i >= backups) or (max_bytes is not None and i and total > max_bytes):
            fs.delete(f.getPath(), False)
            gone.append(f.getPath().getName())
    return gone


def sweep_empty(spark: SparkSession, root: str) -> list[str]:
    """Deletes the empty folders under ``root``, from the deepest up; ``root`` stays. The folders that went."""
    fs, top = _filesystem(spark, root)
    top = fs.makeQualified(top)
    gone: list[str] = []

    def swept(folder) -> bool:
        inside = [swept(f.getPath()) if f.isDirectory() else False for f in fs.listStatus(folder)]
        if not all(inside) or folder.equals(top):
            return False
        gone.append(folder.toString())
        return bool(fs.delete(folder, False))

    swept(top)
    return gone


def dry_run(df: DataFrame) -> int:
    """Runs the plan without keeping anything; the number of rows."""
    return df.count()


def export_labels(sessions: DataFrame, path: str) -> None:
    """The results of labelling sessions (session_id, labeler_id, results), one row each."""
    sessions.select("session_id", "labeler_id", F.explode("results").alias("r")).select("session_id", "labeler_id", "r.*").write.mode("overwrite").json(path)


class Snapshots:
    """Named copies of a table under a folder, each with a manifest of its files' checksums."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, df: DataFrame, description: str = "") -> str:
        name = uuid.uuid4().hex
        data = f"{self.root}/data/{name}"
        df.write.parquet(data)
        files = manifest_of(self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(data))
        files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "size", "checksum").write.parquet(f"{self.root}/manifest/{name}")
        row = self.spark.range(1).select(F.lit(name).alias("id"), F.lit(description).alias("description"), F.current_timestamp().alias("created_at"))
        row.write.mode("append").parquet(f"{self.root}/index")
        return name

    def list(self) -> DataFrame:
        """Newest first."""
        return self.spark.read.parquet(f"{self.root}/index").orderBy(F.desc("created_at"), "id")

    def problems(self, name: str) -> DataFrame:
        """Files of a snapshot that are missing or changed."""
        want = self.spark.read.parquet(f"{self.root}/manifest/{name}")
        got = manifest_of(self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data/{name}"))
        return verify_manifest(want, got.select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "checksum"))

    def restore(self, name: str) -> DataFrame:
        """The snapshot's rows, after its files were checked."""
        if not name.isalnum():
            raise ValueError("a snapshot's name has letters and digits only")
        bad = self.problems(name).limit(3).collect()
        if bad:
            raise ValueError(f"snapshot {name} is damaged: {[(r['path'], r['problem']) for r in bad]}")
        return self.spark.read.parquet(f"{self.root}/data/{name}")


def export_bundle(df: DataFrame, path: str) -> None:
    """A table and the manifest of its files in one folder, to be carried elsewhere."""
    df.write.parquet(f"{path}/data")
    files = manifest_of(df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data"))
    files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "size", "checksum").coalesce(1).write.json(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The table of a bundle, after every file was held against the manifest."""
    want = spark.read.schema("path string, size long, checksum string").json(f"{path}/manifest")
    got = manifest_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data"))
    bad = verify_manifest(want, got.select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "checksum")).limit(3).collect()
    if bad:
        raise ValueError(f"the bundle is damaged: {[(r['path'], r['problem']) for r in bad]}")
    return spark.read.parquet(f"{path}/data")


def notify(events: DataFrame, send: Callable[[dict], None], attempts: int = 3, base: float = 1.0) -> DataFrame:
    """(event_id, status, attempts, error): sends each event from the executors, with doubling waits between tries."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            rows = []
            for event in b.to_dict("records"):
                said = None
                for n in range(1, attempts + 1):
                    try:
                        send(event)
                        rows.append((event["event_id"], "sent", n, None))
                        break
                    except Exception as e:  # any failure of a sender is a result of its event
                        said = f"{type(e).__name__}: {e}"
                        if n < attempts:
                            time.sleep(base * 2 ** (n - 1))
                else:
                    rows.append((event["event_id"], "failed", attempts, said))
            yield pd.DataFrame(rows, columns=["event_id", "status", "attempts", "error"])

    return events.mapInPandas(run, "event_id string, status string, attempts int, error string")
