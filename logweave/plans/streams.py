"""Queries over streams that keep state, deliver or record: rates, labelling sessions, notices, query states, pipes, records' errors."""

from __future__ import annotations

import json
import os
import threading

import pandas as pd
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import embedding, preprocess, retention
from ..session import local_path, read_table, scratch
from ..sources.delivery import NoticeSink
from ..sources.pipe import LineFeed
from ..streaming import daemon, jobs, stateful
from .lines import LINES_SQL, log_lines
from .registry import query

RELEASES = """WITH e AS (SELECT event_id, event_type, ts, floor(epoch(ts) / 1800)::BIGINT AS w, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events),
r AS (SELECT event_id, event_type, (n // 2 + max(w - n // 2) OVER (PARTITION BY event_type, n % 2 ORDER BY n))::BIGINT AS release FROM e)"""


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


@query(f"{RELEASES} SELECT * FROM r")
def rate_release(spark, sf_dir):
    """When each event leaves, with two of a kind each half hour."""
    return stateful.release_windows(_events(spark, sf_dir), 2, 1800, ["event_id"], by="event_type").select("event_id", "event_type", "release")


@query(f"{RELEASES} SELECT * FROM r WHERE release * 1800 <= (SELECT epoch(max(ts)) FROM events)")
def stream_rate_limited(spark, sf_dir):
    """The same as a stream: what has left by the time of the last event."""
    folder, beside = scratch(spark), stateful.stateful_session(spark)
    _events(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = beside.readStream.schema("event_id long, ts timestamp, event_type string").parquet(f"{folder}/in")
    left = stateful.rate_limited(stream, 2, 1800, by="event_type", order="event_id", late="0 seconds").select("event_id", "event_type", "release")
    left.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


SESSIONS = """WITH RECURSIVE a AS (
  SELECT (user_id % 40)::VARCHAR AS session, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n, (3 + (user_id % 40) * 5)::BIGINT AS total,
    CASE event_type WHEN 'error' THEN 'back' WHEN 'view' THEN 'skip' ELSE 'label' END AS action, CASE event_type WHEN 'view' THEN 'skip' ELSE event_type END AS label
  FROM events),
f AS (
  SELECT DISTINCT session, 0::BIGINT AS n, []::VARCHAR[] AS held FROM a
  UNION ALL
  SELECT a.session, a.n, CASE WHEN a.action = 'back' THEN list_slice(held, 1, len(held) - 1) WHEN len(held) < a.total THEN list_append(held, a.label) ELSE held END
  FROM f JOIN a ON a.session = f.session AND a.n = f.n + 1),
last AS (SELECT session, arg_max(held, n) AS held FROM f GROUP BY session)"""


def _actions(spark, sf_dir):
    kind = F.col("event_type")
    return read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).cast("string").alias("session"), F.col("event_id").alias("seq"), (3 + (F.col("user_id") % 40) * 5).alias("total"),
        F.when(kind == "error", "back").when(kind == "view", "skip").otherwise("label").alias("action"), kind.alias("label"),
    )


@query(f"{SESSIONS} SELECT session, (unnest(range(1, len(held) + 1)) - 1)::INTEGER AS position, unnest(held) AS label FROM last")
def sessions_replayed(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    return stateful.replayed(actions, actions.groupBy("session").agg(F.max("total").alias("total")))


@query(f"{SESSIONS} SELECT session, len(held)::BIGINT AS labelled, len(list_filter(held, lambda x: x = 'skip'))::BIGINT AS skipped, md5(array_to_string(held, ',')) AS labels FROM last")
def stream_sessions(spark, sf_dir):
    """The same as a stream: where each session stands after its last action."""
    folder, beside = scratch(spark), stateful.stateful_session(spark)
    actions = _actions(spark, sf_dir)
    actions.write.parquet(f"{folder}/in")
    stream = beside.readStream.schema(actions.schema).parquet(f"{folder}/in")

    def keep(batch, _):
        batch.write.mode("append").parquet(f"{folder}/out")

    done = stateful.labelled(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    done.trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("session").agg(F.max_by(F.struct("labelled", "skipped", "labels"), "seq").alias("x"))
    return last.select("session", "x.labelled", "x.skipped", F.md5(F.array_join("x.labels", ",").cast("binary")).alias("labels"))


@query("SELECT 'e' || event_id AS event_id, count(*) AS times FROM events WHERE event_type = 'error' GROUP BY ALL")
def notices_delivered(spark, sf_dir):
    """How often each alert was delivered by a query that failed half-way, ran again, and ran once more."""
    folder = scratch(spark)
    sent, ledger = (f"{local_path(spark, folder)}/{x}" for x in ("sent", "ledger"))
    spark.dataSource.register(NoticeSink)
    alerts = read_table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"))
    alerts.write.parquet(f"{folder}/in")
    os.makedirs(ledger)
    for attempt in range(3):
        stream = spark.readStream.schema(alerts.schema).parquet(f"{folder}/in")
        fuse = f"{ledger}/blown"

        def checked(batches, fuse=fuse):
            for b in batches:
                yield b
                if not os.path.exists(fuse):
                    open(fuse, "w").close()
                    raise RuntimeError("lost half-way")

        out = stream.mapInPandas(checked, "event_id long, name string").select(F.col("name").alias("event_id"), F.to_json(F.struct("event_id")).alias("payload"))
        writer = out.writeStream.format("logweave-notices").option("kind", "lines").option("settings", json.dumps({"folder": sent})).option("ledger", ledger)
        q = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            if attempt:
                raise
    got = spark.read.schema("key string, payload string").json(f"file://{sent}")
    return got.groupBy(F.split_part("key", F.lit("-"), F.lit(2)).alias("event_id")).agg(F.count("*").alias("times"))


@query(
    """SELECT 'fails' AS name, 'error' AS state, 1 AS runs, 1 AS errors, 0 AS rows, true AS timed
UNION ALL SELECT 'works', 'stopped', 2, 0, (SELECT count(*) FROM events), true"""
)
def daemon_states(spark, sf_dir):
    """What the table of states says of a query that ran twice and of one that failed."""
    folder = scratch(spark)
    events = read_table(spark, sf_dir, "events").select("event_id")
    events.write.parquet(f"{folder}/in")
    recorder = daemon.Recorder(spark, f"{folder}/states")
    spark.streams.addListener(recorder)

    def started(name, handle):
        def start(_):
            stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            return stream.writeStream.queryName(f"{name}-{folder[-8:]}").foreachBatch(handle).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()

        return daemon.Daemon(recorder, f"{name}-{folder[-8:]}", start)

    def works(batch, _):
        batch.write.format("noop").mode("overwrite").save()

    def fails(batch, _):
        raise ValueError("on purpose")

    try:
        for name, handle in (("works", works), ("works", works), ("fails", fails)):
            one = started(name, handle)
            try:
                one.start().awaitTermination()
            except Exception:
                if name == "works":
                    raise
            one.stop()
    finally:
        spark.streams.removeListener(recorder)
    said = daemon.status(daemon.history(spark, f"{folder}/states")).where(F.col("name").endswith(folder[-8:]))
    return said.select(
        F.split_part("name", F.lit("-"), F.lit(1)).alias("name"), "state", F.col("runs").cast("int").alias("runs"), F.col("errors").cast("int").alias("errors"), "rows", (F.col("uptime") > 0).alias("timed")
    )


def _drained(q, sender, arrived, total: int, patience: int = 600) -> None:
    """Returns when the sender is done and ``total`` lines have arrived, however long that takes; an error if none does for long."""
    before, still = None, 0
    while True:
        q.awaitTermination(0.2)
        if sender.is_alive():
            continue
        now = arrived()
        if now >= total:
            return
        before, still = now, still + 1 if now == before else 0
        if still >= patience:
            raise RuntimeError(f"{now} of {total} lines have arrived")


@query(f"WITH {LINES_SQL} SELECT line, count(*) AS n FROM log_lines WHERE id % 5 = 0 GROUP BY line")
def piped_lines(spark, sf_dir):
    """A fifth of the lines, written into a named pipe in two parts, a query for each that goes on from the other's checkpoint."""
    folder = scratch(spark)
    here = local_path(spark, folder)
    spark.dataSource.register(LineFeed)
    os.mkfifo(f"{here}/pipe")
    rows = log_lines(spark, sf_dir).where("id % 5 = 0").select("line", (F.col("id") % 2).alias("half"))
    wanted = {r["half"]: r["count"] for r in rows.groupBy("half").count().collect()}

    def feed(batches):
        with open(f"{here}/pipe", "w", encoding="utf-8") as f:
            for b in batches:
                f.writelines(line + "\n" for line in b["line"])
                yield pd.DataFrame({"n": [len(b)]})

    total = 0
    for half in (0, 1):
        stream = spark.readStream.format("logweave-lines").option("path", f"{here}/pipe").option("spool", f"{here}/spool").option("maxLines", "20000").option("buffer", "50000").load()
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
        q = writer.trigger(processingTime="100 milliseconds").start()
        sender = threading.Thread(target=lambda half=half: rows.where(F.col("half") == half).select("line").coalesce(1).mapInPandas(feed, "n long").collect(), daemon=True)
        sender.start()
        total += wanted.get(half, 0)
        arrived = lambda: spark.read.schema("number long").parquet(f"{folder}/out").count() if os.path.isdir(f"{here}/out") else 0
        try:
            _drained(q, sender, arrived, total)
        finally:
            q.stop()
    return spark.read.schema("line string, number long").parquet(f"{folder}/out").groupBy("line").agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN upper(event_type) ELSE event_type END AS event_type, CASE WHEN event_id % 7 <> 0 AND value >= 5 THEN round(value * 2, 4) END AS doubled,
  CASE WHEN event_id % 7 = 0 THEN 'shout: ValueError: seven' || CASE WHEN value < 5 THEN '; double: small' ELSE '; double: nothing to double' END WHEN value < 5 THEN 'double: small' ELSE '' END AS errors FROM events"""
)
def record_errors(spark, sf_dir):
    """Records that a stage fails on keep their fields and say what failed; all others are as without them."""

    def shout(r):
        if r["event_id"] % 7 == 0:
            raise ValueError("seven")
        return {"event_type": r["event_type"].upper(), "twice": r["value"] * 2}

    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    small = F.when(F.col("value") < 5, "small").when(F.col("twice").isNull(), "nothing to double")
    stages = [
        preprocess.record_stage("shout", shout, "event_type string, twice double", ["event_id", "event_type", "value"]),
        preprocess.checked_stage("double", {"doubled": F.round("twice", 4)}, small),
    ]
    done = preprocess.pipeline(stages)(e)
    said = F.array_join(F.transform("errors", lambda x: F.concat(x["stage"], F.lit(": "), x["error"])), "; ")
    return done.select("event_id", "event_type", "doubled", said.alias("errors"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 'dead' ELSE 'done' END AS outcome FROM events")
def stream_dead_letters(spark, sf_dir):
    """Four batches, of which one fails: its rows are put aside and the stream goes on."""
    folder = scratch(spark)
    read_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("part")).repartition("part").write.partitionBy("part").parquet(f"{folder}/in")
    stream = spark.readStream.schema("event_id long, part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def handle(batch, number):
        if batch.where("part = 2").limit(1).count():
            raise ValueError("this batch fails")
        batch.write.mode("append").parquet(f"{folder}/done")

    jobs.micro_batches(stream, handle, f"{folder}/checkpoint", seconds=None, dead_letters=f"{folder}/dead").awaitTermination()
    done = spark.read.schema("event_id long").parquet(f"{folder}/done").select("event_id", F.lit("done").alias("outcome"))
    return done.unionAll(spark.read.schema("event_id long").json(f"{folder}/dead").select("event_id", F.lit("dead").alias("outcome")))


@query("SELECT doc_id, 1.0::DOUBLE AS norm, true AS as_in_batch FROM documents")
def stream_embedded(spark, sf_dir):
    """Documents embedded as a stream, against the same documents embedded as a batch."""
    folder, provider = scratch(spark), embedding.mock_provider(16)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    docs.write.parquet(f"{folder}/in")
    stream = jobs.embedded(spark.readStream.schema(docs.schema).parquet(f"{folder}/in"), provider)
    q = stream.select("doc_id", "embedding").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    q.trigger(availableNow=True).start().awaitTermination()
    batch = embedding.embed_records(docs, provider).select("doc_id", F.col("embedding").alias("whole"))
    both = spark.read.schema("doc_id long, embedding array<float>").parquet(f"{folder}/out").join(batch, "doc_id")
    return both.select("doc_id", F.round(V.norm(F.col("embedding")), 4).cast("double").alias("norm"), (F.col("embedding") == F.col("whole")).alias("as_in_batch"))


@query(
    """SELECT CASE WHEN event_id % 3 <> 0 AND value <= 400 THEN 'kept' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'deleted' END AS event, 'f' || event_id AS path,
  CASE WHEN event_id % 3 = 0 THEN 'third' || CASE WHEN value > 400 THEN ',large' ELSE '' END WHEN value > 400 THEN 'large' ELSE '' END AS reasons,
  CASE WHEN (event_id % 3 = 0 OR value > 400) AND event_id % 5 = 0 THEN 'OSError: busy' END AS error FROM events"""
)
def retention_events(spark, sf_dir):
    """What an observer was told of a run with criteria of one's own, in which every fifth file can't be deleted."""
    files = read_table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("value").alias("size_bytes"))
    decided = retention.judged(files, [retention.Criterion("third", F.col("event_id") % 3 == 0), retention.Criterion("large", retention.over_size(F.col("size_bytes"), 400))])

    def remove(path):
        if int(path[1:]) % 5 == 0:
            raise OSError("busy")

    told = []
    retention.carried_out(decided, remove, {"listener": told.append})
    return told[0].select("event", "path", F.array_join("reasons", ",").alias("reasons"), "error")
