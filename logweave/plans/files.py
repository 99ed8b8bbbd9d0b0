"""Queries that go through sources and sinks: what is written is read again and held against the tables."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from ..functions.keys import KeyRing
from ..session import local_path, read_table, scratch
from ..sources import files, sinks
from ..sources.tail import TailSource
from .lines import LINES_SQL, RECORDS_SQL, log_lines, records
from .registry import query

COUNTED = f"WITH {LINES_SQL} SELECT line, count(*) AS n FROM log_lines GROUP BY line"


def _written_lines(spark, sf_dir) -> str:
    folder = f"{scratch(spark)}/lines"
    log_lines(spark, sf_dir).select("line").repartition(4).write.text(folder)
    return folder


@query(COUNTED)
def file_lines(spark, sf_dir):
    return files.read_lines(spark, _written_lines(spark, sf_dir)).groupBy("line").agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL} SELECT line, count(*) AS n, 4 AS files FROM log_lines GROUP BY line")
def numbered_lines(spark, sf_dir):
    """Each file's line numbers run from 1 without a gap."""
    rows = files.read_lines(spark, _written_lines(spark, sf_dir), glob="*.txt", numbered=True)
    whole = rows.groupBy("source").agg((F.max("line_num") == F.count("*")).alias("whole")).where("whole").agg(F.count("*").cast("int").alias("files"))
    return rows.groupBy("line").agg(F.count("*").alias("n")).join(whole, F.lit(True))


@query("SELECT 'folder' AS kind, count(*) AS n FROM events UNION ALL SELECT 'files', 4")
def source_dispatch(spark, sf_dir):
    folder = _written_lines(spark, sf_dir)
    lines = files.open_source(spark, folder).agg(F.lit("folder").alias("kind"), F.count("*").alias("n"))
    return lines.unionAll(files.discover(spark, folder, glob="*.txt").agg(F.lit("files").alias("kind"), F.count("*").alias("n")))


@query(f"WITH {RECORDS_SQL} SELECT id % 97 AS k, level, service, msg, error_code, request_id, count(*) AS n, min(strftime(ts, '%Y-%m-%d')) AS first_day FROM records GROUP BY ALL")
def json_log(spark, sf_dir):
    folder = f"{scratch(spark)}/log"
    rows = records(spark, sf_dir).select("level", "service", "msg", "duration", "error_code", "request_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    sinks.write_log(rows, folder, backups=1000)
    log = files.read_log(spark, folder)
    key = F.substring_index("request_id", "-", -1).cast("long").alias("k")
    return log.groupBy(key, "level", "service", "msg", "error_code", "request_id").agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first_day"))


def _append(rows, folder: str, ends: dict[int, int]) -> dict[int, int]:
    """Each task writes its lines behind the first ``ends`` bytes of its own file, so that one that runs again does no harm; how long the files are then."""

    def run(batches):
        part, n = None, 0
        for b in batches:
            for part, line in zip(b["part"], b["line"]):
                if n == 0:
                    path = f"{folder}/part-{part}.log"
                    f = open(path, "r+b" if os.path.exists(path) else "w+b")
                    n = f.truncate(ends.get(part, 0))
                    f.seek(n)
                n += f.write(line.encode() + b"\n")
        if part is not None:
            f.close()
            yield pd.DataFrame({"part": [part], "n": [n]})

    return {r["part"]: r["n"] for r in rows.repartitionByRange(4, "part").mapInPandas(run, "part int, n long").collect()}


@query(COUNTED)
def tailed_lines(spark, sf_dir):
    """Half of the lines, a stopped query, a file renamed, the other half, and the query started again: each line once."""
    folder = scratch(spark)
    logs = f"{local_path(spark, folder)}/logs"
    os.makedirs(logs)
    spark.dataSource.register(TailSource)
    rows = log_lines(spark, sf_dir).select("line", F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int").alias("part"))
    ends: dict[int, int] = {}
    for half in (0, 1):
        ends = _append(rows.where(F.col("half") == half), logs, ends)
        lines = spark.readStream.format("logweave-tail").option("path", logs).option("maxLines", "1000000").load()
        stream = lines.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").start()
        stream.processAllAvailable()
        stream.stop()
        if half == 0:
            os.rename(f"{logs}/part-2.log", f"{logs}/part-2.log.1")
            ends.pop(2, None)
    return spark.read.parquet(f"{folder}/out").groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_restore(spark, sf_dir):
    snapshots = sinks.Snapshots(spark, f"{scratch(spark)}/snapshots")
    return snapshots.restore(snapshots.create(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nations"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def bundle_import(spark, sf_dir):
    folder = f"{scratch(spark)}/bundle"
    sinks.export_bundle(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), folder)
    return sinks.import_bundle(spark, folder)


@query("SELECT user_id % 5 AS session_id, 'l' || (user_id % 5) AS labeler_id, event_id AS pair, event_type AS label FROM events")
def exported_labels(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("session_id", F.col("user_id") % 5)
    sessions = e.groupBy("session_id", "user_id").agg(F.collect_list(F.struct(F.col("event_id").alias("pair"), F.col("event_type").alias("label"))).alias("results"))
    sessions = sessions.withColumn("labeler_id", F.concat(F.lit("l"), F.col("session_id").cast("string")))
    folder = f"{scratch(spark)}/labels"
    sinks.export_labels(sessions, folder)
    return spark.read.schema("session_id long, labeler_id string, pair long, label string").json(folder)


@query("SELECT count(*) AS n FROM events")
def dry_run_count(spark, sf_dir):
    return spark.createDataFrame([(sinks.dry_run(log_lines(spark, sf_dir)),)], "n long")


@query("SELECT doc_id, text AS opened, text AS reopened, true AS renewed FROM documents")
def rotated_keys(spark, sf_dir):
    ring = KeyRing()
    ring.add(b"0123456789abcdef0123456789abcdef", "first")
    sealed = read_table(spark, sf_dir, "documents").select("doc_id", ring.encrypt(F.col("text")).alias("sealed"))
    ring.add(b"another key of thirty-two bytes.", "second")
    fresh = sealed.withColumn("fresh", ring.seal_anew(F.col("sealed")))
    return fresh.select("doc_id", ring.decrypt(F.col("sealed")).alias("opened"), ring.decrypt(F.col("fresh")).alias("reopened"), F.col("fresh").startswith("second:").alias("renewed"))
