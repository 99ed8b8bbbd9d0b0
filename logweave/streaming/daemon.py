"""States of streaming queries as a table: starting, running, stopped, error.

A listener writes a row for each change of a query's state, with what it has done until then, to a
folder of any store. Status and uptime are questions to that table, so they outlive the driver.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "query string, run string, name string, state string, at timestamp, batches long, rows long, message string"


class Recorder(StreamingQueryListener):
    """Writes the changes of all queries of a session to ``path``; add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.seen: dict[str, dict] = {}
        self.changed = threading.Condition()
        jvm = spark.sparkContext._jvm
        self.fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path))

    def _note(self, run: str, state: str, message: str | None = None) -> None:
        with self.changed:
            row = self.seen[run]
            row.update(state=state, message=message, at=datetime.now(timezone.utc).isoformat())
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
            out = self.fs.create(at)
            out.write(bytearray(json.dumps(row).encode() + b"\n"))
            out.close()
            self.changed.notify_all()

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.runId)] = {"query": str(event.id), "run": str(event.runId), "name": event.name, "batches": 0, "rows": 0}
        self._note(str(event.runId), "starting")

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        if run in self.seen:
            self.seen[run]["batches"] += 1
            self.seen[run]["rows"] += event.progress.numInputRows
            if self.seen[run]["state"] == "starting":
                self._note(run, "running")

    def onQueryIdle(self, event) -> None:
        run = str(event.runId)
        if run in self.seen and self.seen[run]["state"] == "starting":
            self._note(run, "running")

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if run in self.seen:
            self._note(run, "error" if event.exception else "stopped", event.exception)

    def wait(self, query: StreamingQuery, states: tuple[str, ...] = ("stopped", "error"), seconds: float = 60) -> str | None:
        """The state of a query's run once it is one of ``states``; listeners are told a little later than the query's own thread."""
        with self.changed:
            self.changed.wait_for(lambda: self.seen.get(str(query.runId), {}).get("state") in states, seconds)
            return self.seen.get(str(query.runId), {}).get("state")


def history(spark: SparkSession, path: str) -> DataFrame:
    """All changes of state that were written to a folder."""
    return spark.read.schema(SCHEMA).json(path)


def runs(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """(query, run, name, state, started, ended, uptime in seconds, batches, rows, message): one row for each run.

    A run that neither stopped nor failed is up until ``now``, the query's start unless one is given.
    """
    over = F.col("state").isin("stopped", "error")
    rank = F.struct("at", F.when(F.col("state") == "starting", 0).when(F.col("state") == "running", 1).otherwise(2))
    by = changes.groupBy("query", "run").agg(
        *[F.max_by(c, rank).alias(c) for c in ("name", "state", "batches", "rows", "message")], F.min("at").alias("started"), F.max(F.when(over, F.col("at"))).alias("ended")
    )
    end = F.coalesce("ended", F.current_timestamp() if now is None else now)
    return by.withColumn("uptime", F.round((F.unix_micros(end) - F.unix_micros("started")) / 1e6, 3)).select(
        "query", "run", "name", "state", "started", "ended", "uptime", "batches", "rows", "message"
    )


def status(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """(query, name, state, runs, errors, uptime, batches, rows): one row for each query, over all of its runs; the state is that of the last."""
    each = runs(changes, now)
    last = Window.partitionBy("query").orderBy(F.desc("started"), F.desc("run"))
    return (
        each.withColumn("__last", F.row_number().over(last) == 1).groupBy("query")
        .agg(
            F.max_by("name", "started").alias("name"), F.max(F.when(F.col("__last"), F.col("state"))).alias("state"), F.count("*").alias("runs"),
            F.count_if(F.col("state") == "error").alias("errors"), F.round(F.sum("uptime"), 3).alias("uptime"), F.sum("batches").alias("batches"), F.sum("rows").alias("rows"),
        )
    )


class Daemon:
    """A query that is started and stopped by name; one that is running isn't started again."""

    def __init__(self, recorder: Recorder, name: str, start: Callable[[str], StreamingQuery]):
        self.recorder, self.name, self._start = recorder, name, start
        self.query: StreamingQuery | None = None

    def start(self) -> StreamingQuery:
        if any(q.name == self.name for q in self.recorder.spark.streams.active):
            raise RuntimeError(f"{self.name} is already running")
        self.query = self._start(self.name)
        return self.query

    def stop(self, seconds: float = 60) -> str | None:
        """Stops the query, if it is running; its last state."""
        if self.query is None:
            return None
        if self.query.isActive:
            self.query.stop()
        return self.recorder.wait(self.query, seconds=seconds)
