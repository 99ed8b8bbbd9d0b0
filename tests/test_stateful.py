"""Streams with state: rates, labelling sessions, notices sent once, daemon states, pipes."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.streaming import stateful


def _run(stream, out, checkpoint, mode="append"):
    writer = stream.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", str(checkpoint))
    q = (writer.option("path", str(out)) if mode == "append" else writer.queryName(str(out))).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _plain_release(events, most, seconds):
    """Windows by the definition: the first with room, in order."""
    out, taken = {}, {}
    for key, t, i in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        window = max(t // seconds, taken.get(key, (-1, 0))[0])
        if window == taken.get(key, (-1, 0))[0] and taken[key][1] >= most:
            window += 1
        used = taken[key][1] + 1 if taken.get(key, (-1, 0))[0] == window else 1
        taken[key] = (window, used)
        out[i] = window
    return out


@pytest.fixture(scope="module")
def beside(spark):
    return stateful.stateful_session(spark)


def _events(rng, n, keys, span):
    return [(rng.choice(keys), rng.randrange(span), i) for i in range(n)]


def test_release_windows(spark):
    rng = random.Random(2)
    events = _events(rng, 600, ["a", "a", "a", "b", None], 50) + [("c", 7, 1000 + i) for i in range(35)]
    df = spark.createDataFrame(events, "target string, t long, id long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["release"] for r in stateful.release_windows(df, 10, 5, ["id"]).collect()}
    assert got == _plain_release(events, 10, 5)
    assert stateful.release_windows(df.limit(0), 10, 5, ["id"]).count() == 0


def test_rate_by_event_time(spark, beside, tmp_path):
    # A thousand events at once leave a hundred a window; the clock of the windows is what later events say.
    zero = 1_000_000_000
    first = [("slack", zero, i) for i in range(1000)] + [("mail", zero + 3, 5000)]
    ticks = [("tick", zero + 10 * k + 1, 9000 + k) for k in range(1, 11)]
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    got = []
    for batch, rows in enumerate([first, *[[t] for t in ticks]]):
        (source / f"{batch:02}.json").write_text("".join(json.dumps({"target": k, "t": t, "id": i}) + "\n" for k, t, i in rows))
        stream = beside.readStream.schema("target string, t long, id long").json(str(source)).withColumn("ts", F.timestamp_seconds("t"))
        # Every batch is a query started anew: what waits is in the checkpoint.
        _run(stateful.rate_limited(stream, 100, 10, order="id", late="0 seconds"), out, tmp_path / "cp")
        got.append({r["id"]: r["release"] for r in spark.read.parquet(str(out)).where("target = 'slack'").collect()})
    assert [len(g) for g in got] == [100 * (i + 1) for i in range(10)] + [1000]
    assert got[-1] == {i: zero // 10 + i // 100 for i in range(1000)}
    everything = spark.read.parquet(str(out))
    assert everything.count() == everything.select("id").distinct().count()


def test_rate_by_the_clock(spark, beside, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.json").write_text("".join(json.dumps({"target": "x", "ts": "2024-01-01T00:00:00Z", "id": i}) + "\n" for i in range(25)))
    stream = beside.readStream.schema("target string, ts timestamp, id long").json(str(source))
    q = stateful.rate_limited(stream, 10, 2, order="id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).trigger(processingTime="500 milliseconds").start()
    try:
        end = dt.datetime.now() + dt.timedelta(seconds=90)
        while dt.datetime.now() < end and (not out.exists() or spark.read.schema("id long").parquet(str(out)).count() < 25):
            q.awaitTermination(1)
    finally:
        q.stop()
    rows = [r["release"] for r in spark.read.parquet(str(out)).orderBy("id").collect()]
    assert len(rows) == 25 and rows == sorted(rows)
    assert sorted(rows.count(w) for w in set(rows)) == [5, 10, 10]


class PlainSession:
    def __init__(self, total):
        self.total, self.index, self.results = total, 0, []

    def step(self, action, label):
        if action == "back":
            if self.index > 0:
                self.index -= 1
                if self.results and self.results[-1][0] == self.index:
                    self.results.pop()
        elif self.index < self.total:
            self.results.append((self.index, "skip" if action == "skip" else label))
            self.index += 1


def _sessions(rng, n):
    actions, plain = [], {}
    for s in range(n):
        plain[str(s)] = PlainSession(rng.choice([0, 1, 3, 10]))
        for i in range(rng.randint(1, 40)):
            action, label = rng.choices(["label", "skip", "back"], [5, 2, 3])[0], rng.choice(["same", "different"])
            actions.append((str(s), i, action, label, plain[str(s)].total))
            plain[str(s)].step(action, label)
    return actions, plain


def test_sessions_replayed(spark):
    actions, plain = _sessions(random.Random(3), 30)
    df = spark.createDataFrame([*actions, (None, 1, "label", "same", 3), ("0", 99, "other", "same", 3)], "session string, seq long, action string, label string, total long").repartition(3)
    sessions = df.where("session is not null and action <> 'other'").groupBy("session").agg(F.max("total").alias("total"))
    got = sorted((r["session"], r["position"], r["label"]) for r in stateful.replayed(df, sessions).collect())
    assert got == sorted((s, i, label) for s, p in plain.items() for i, label in p.results)


def test_sessions_streamed(spark, beside, tmp_path):
    actions, plain = _sessions(random.Random(4), 8)
    source = tmp_path / "in"
    source.mkdir()
    cut = [a for a in actions if a[1] < 12], [a for a in actions if a[1] >= 12]
    names = ("session", "seq", "action", "label", "total")
    seen = {}

    def keep(batch, _):
        seen.update({r["session"]: r for r in batch.orderBy("seq").collect()})

    for i, part in enumerate(cut):
        (source / f"{i}.json").write_text("".join(json.dumps(dict(zip(names, a))) + "\n" for a in part))
        stream = beside.readStream.schema("session string, seq long, action string, label string, total long").json(str(source))
        stateful.labelled(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    for s, p in plain.items():
        r = seen[s]
        assert r["labels"] == [label for _, label in p.results]
        assert (r["labelled"], r["remaining"]) == (len(p.results), p.total - len(p.results))
        assert r["skipped"] == sum(label == "skip" for _, label in p.results)


class Hook:
    """A local web hook that refuses after some requests."""

    def __init__(self, good):
        import http.server
        import threading

        self.keys, self.good = [], good
        hook = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                self.rfile.read(int(self.headers["Content-Length"]))
                fine = hook.good is None or len(hook.keys) < hook.good
                if fine:
                    hook.keys.append(self.headers["Idempotency-Key"])
                self.send_response(200 if fine else 500)
                self.end_headers()

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/"


def test_notices_are_sent_once(spark, tmp_path):
    from logweave.sources.delivery import NoticeSink, NoticeWriter

    spark.dataSource.register(NoticeSink)
    spark.range(40).selectExpr("concat('e', id) AS event_id", "'{}' AS payload").repartition(3).write.parquet(str(tmp_path / "in"))
    hook = Hook(17)

    def run():
        stream = spark.readStream.schema("event_id string, payload string").parquet(str(tmp_path / "in")).repartition(2)
        writer = stream.writeStream.format("logweave-notices").option("kind", "webhook").option("settings", json.dumps({"url": hook.url})).option("ledger", f"file://{tmp_path}/ledger")
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="500|Internal"):
        run()
    assert len(hook.keys) == 17
    hook.good = None
    run()
    run()
    assert sorted(hook.keys) == sorted(f"0-e{i}" for i in range(40))
    assert json.loads((tmp_path / "ledger" / "batch=0" / "done.json").read_text()) == {"sent": 23, "skipped": 17}
    with pytest.raises(ValueError):
        NoticeWriter({"kind": "webhook", "ledger": str(tmp_path)})
    old = NoticeWriter({"kind": "lines", "settings": json.dumps({"folder": str(tmp_path)}), "ledger": str(tmp_path / "ledger"), "keep": "2"})
    old.commit([None], 2)
    assert sorted(p.name for p in (tmp_path / "ledger").iterdir()) == ["batch=2"]


def test_daemon_states(spark, tmp_path):
    from logweave.streaming import daemon

    recorder = daemon.Recorder(spark, f"file://{tmp_path}/states")
    spark.streams.addListener(recorder)
    spark.range(10).write.parquet(str(tmp_path / "in"))
    fail = []

    def each(batch, _):
        if fail:
            raise ValueError("no")
        batch.count()

    def start(name):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        return stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).start()

    watch = daemon.Daemon(recorder, "watch", start)
    try:
        q = watch.start()
        assert recorder.wait(q, ("running",)) == "running"
        with pytest.raises(RuntimeError):
            watch.start()
        up = daemon.status(daemon.history(spark, f"file://{tmp_path}/states"), F.current_timestamp() + F.expr("interval 1 hour")).first()
        assert (up["name"], up["state"], up["runs"]) == ("watch", "running", 1) and 3600 <= up["uptime"] < 3700
        q.processAllAvailable()
        assert watch.stop() == "stopped"
        fail.append(1)
        spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
        q = watch.start()
        with pytest.raises(Exception):
            q.awaitTermination(60)
        assert watch.stop() == "error"
        changes = daemon.history(spark, f"file://{tmp_path}/states")
        row = daemon.status(changes).first()
        assert (row["state"], row["runs"], row["errors"], row["rows"]) == ("error", 2, 1, 10)
        each_run = daemon.runs(changes).orderBy("started").collect()
        assert [r["state"] for r in each_run] == ["stopped", "error"] and each_run[0]["uptime"] > 0 and "no" in each_run[1]["message"]
        assert [r["state"] for r in changes.where(F.col("run") == each_run[0]["run"]).orderBy("at").collect()] == ["starting", "running", "stopped"]
    finally:
        spark.streams.removeListener(recorder)


def test_lines_through_a_pipe(spark, tmp_path):
    import os
    import threading

    from logweave.sources.pipe import LineFeed

    spark.dataSource.register(LineFeed)
    pipe = str(tmp_path / "pipe")
    os.mkfifo(pipe)

    def feed(lines):
        with open(pipe, "w", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in lines)

    def query():
        stream = spark.readStream.format("logweave-lines").option("path", pipe).option("spool", f"file://{tmp_path}/spool").option("maxLines", "7").option("buffer", "50").load()
        return stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(processingTime="100 milliseconds").start()

    def done():
        return sorted(r["line"] for r in spark.read.schema("line string").parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []

    sent = []
    for part in range(2):
        q = query()
        lines = [f"line {part} {i}" for i in range(120)]
        sent += lines
        thread = threading.Thread(target=feed, args=(lines,), daemon=True)
        thread.start()
        end = dt.datetime.now() + dt.timedelta(seconds=90)
        while dt.datetime.now() < end and len(done()) < len(sent):
            q.awaitTermination(0.5)
        q.stop()
        assert done() == sorted(sent)


def test_piped_lines_are_waited_for():
    """However long the sender takes and lines arrive, none is left behind; what never comes is an error, not a short result."""
    from types import SimpleNamespace

    from logweave.plans import streams

    polls = {"alive": 700, "lines": 0}

    def alive():
        polls["alive"] -= 1
        return polls["alive"] > 0

    def arrived():
        polls["lines"] += 1
        return polls["lines"]

    q = SimpleNamespace(awaitTermination=lambda _: None)
    streams._drained(q, SimpleNamespace(is_alive=alive), arrived, 650)
    assert polls["alive"] <= 0 and polls["lines"] == 650
    with pytest.raises(RuntimeError, match="3 of 4 lines"):
        streams._drained(q, SimpleNamespace(is_alive=lambda: False), lambda: 3, 4, patience=5)


def test_spool(tmp_path):
    from logweave.sources.pipe import FeedReader, Spool

    spool = Spool(str(tmp_path / "s"))
    for i in range(2500):
        spool.append(b"%d" % i)
    spool.acknowledge(2100)
    assert sorted(int(p.name) for p in (tmp_path / "s").iterdir() if p.name.isdigit()) == [2000]
    spool.file.close()
    with open(tmp_path / "s" / "2000", "ab") as f:
        f.write(b"half")
    again = Spool(str(tmp_path / "s"))
    assert (again.acknowledged, again.next, len(again.lines)) == (2100, 2500, 400)
    again.append(b"next")
    assert Spool(str(tmp_path / "s")).lines[2500] == b"next"
    reader = FeedReader({"path": "/nowhere", "spool": str(tmp_path / "s"), "maxLines": "10"})
    assert reader.initialOffset() == {"at": 2100}
    assert [n for _, n in reader.readBetweenOffsets({"at": 2100}, {"at": 2103})] == [2100, 2101, 2102]
    rows, end = reader.read({"at": 2100})
    assert end == {"at": 2110} and len(list(rows)) == 10
    reader.closed = True
    with pytest.raises(ValueError):
        FeedReader({"spool": str(tmp_path / "t")})


def test_error_channel(spark):
    from logweave.operators import preprocess as P

    rows = [(i, f"m{i}", {"k": str(i)}) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, message string, attrs map<string,string>").repartition(3)

    def change(r):
        if r["id"] % 5 == 0:
            raise ValueError(f"bad {r['id']}")
        if r["id"] == 7:
            return None
        return {"message": r["message"].upper(), "n": "x" if r["id"] == 8 else r["id"] * 2}

    def stage(how):
        return P.record_stage("own", change, "message string, n int", ["id", "message"], how)

    number = P.checked_stage("number", {"half": F.col("n") / 2}, F.when(F.col("id") == 9, F.lit("nine")))
    kept = {r["id"]: r for r in P.pipeline([stage("keep"), number])(df).collect()}
    assert set(kept) == set(range(20)) - {7}
    for i, r in kept.items():
        bad = i % 5 == 0 or i == 8
        assert r["message"] == (f"m{i}" if bad else f"M{i}") and r["n"] == (None if bad else 2 * i) and r["attrs"] == {"k": str(i)}
        assert [e["stage"] for e in r["errors"]] == ["own"] * bad + ["number"] * (i == 9)
        assert r["half"] == (None if bad or i == 9 else i)
    assert kept[5]["errors"][0]["error"] == "ValueError: bad 5"
    done = P.pipeline([stage("keep"), number])(df)
    good, failed = P.split_errors(done)
    assert good.count() + failed.count() == 19 and failed.count() == 6 and "errors" not in good.columns
    assert {(r["stage"], r["n"]) for r in P.error_counts(done).groupBy("stage").agg(F.sum("n").alias("n")).collect()} == {("own", 5), ("number", 1)}
    assert {r["id"] for r in stage("skip")(df).collect()} == {i for i in range(20) if i % 5 and i not in (7, 8)}
    with pytest.raises(Exception, match="own: ValueError: bad"):
        stage("raise")(df).collect()
    assert stage("keep")(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        stage("never")
