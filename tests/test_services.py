"""Notifiers, keys, rotating logs and benchmarks."""

import json
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from logweave.functions.keys import KeyRing
from logweave.operators.benchmark import Benchmark, suite
from logweave.sources import notifiers, sinks


@pytest.fixture
def server():
    """Answers 'ok' to posts and the titles of open issues to searches; what it got is kept."""
    got = []

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body):
            self.send_response(500 if "fail" in self.path else 200)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            got.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self._answer(b"ok")

        def do_GET(self):
            self._answer(json.dumps({"items": [{"title": "known"}]}).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", got
    http.shutdown()


def test_senders(spark, server):
    url, got = server
    events = spark.createDataFrame([("1", json.dumps({"text": "a"})), ("2", json.dumps({"text": "b"}))], "event_id string, payload string")
    sent = sinks.notify(events, notifiers.create("slack", url=url), attempts=1).collect()
    assert [r["status"] for r in sent] == ["sent", "sent"] and sorted(b["text"] for _, _, b in got) == ["a", "b"]
    failed = sinks.notify(events.limit(1), notifiers.create("webhook", url=url + "/fail", token="t"), attempts=2, base=0.01).collect()
    assert [(r["status"], r["attempts"]) for r in failed] == [("failed", 2)] and got[-1][1] == "Bearer t"
    issues = spark.createDataFrame([("1", json.dumps({"title": "known"})), ("2", json.dumps({"title": "new"}))], "event_id string, payload string")
    before = len(got)
    sinks.notify(issues, notifiers.create("github", repository="a/b", token="t", api=url), attempts=1).collect()
    assert [(p, b["title"]) for p, _, b in got[before:]] == [("/repos/a/b/issues", "new")]


def test_notifiers_are_made_by_name():
    with pytest.raises(ValueError, match="unknown kind"):
        notifiers.create("pigeon")
    for kind, settings in (("slack", {}), ("webhook", {"url": "ftp://x"}), ("email", {"sender": "a@b"}), ("github", {"repository": "x"})):
        with pytest.raises(ValueError, match=kind):
            notifiers.create(kind, **settings)
    notifiers.register("list", lambda: [].append)
    assert "list" in notifiers.kinds() and callable(notifiers.create("list"))
    mail = notifiers.create("email", sender="a@b.c", recipients=["d@e.f", "g@h.i"]).message({"payload": json.dumps({"subject": "one\ntwo", "body": "text"})})
    assert (mail["Subject"], mail["To"], mail.get_content()) == ("one two", "d@e.f, g@h.i", "text\n")


def test_keys_rotate(spark):
    now = datetime(2024, 1, 1, tzinfo=UTC)
    ring = KeyRing(max_age_days=30)
    first = ring.add(b"0" * 32, "first", now=datetime.now(UTC))
    df = spark.createDataFrame([("a",), ("",), (None,)], "text string")
    sealed = [r[0] for r in df.select(ring.encrypt(F.col("text"))).collect()]
    assert sealed[0].startswith("first:") and sealed[2] is None
    second = ring.rotate()
    old = spark.createDataFrame([(s,) for s in sealed] + [("gone:abcd",), ("first:broken",)], "s string")
    opened = old.select(ring.decrypt(F.col("s")).alias("t"), ring.seal_anew(F.col("s")).alias("n")).collect()
    assert [r["t"] for r in opened] == ["a", "", None, None, None]
    assert opened[0]["n"].startswith(second.name + ":") and opened[3]["n"] == "gone:abcd"
    ring.drop(first.name)
    assert [k["name"] for k in ring.metadata()] == [second.name]
    with pytest.raises(ValueError):
        ring.drop(second.name)
    aged = KeyRing(max_age_days=30)
    aged.add(b"1" * 16, "old", now=now)
    assert aged.active(now + timedelta(days=29)).name == "old" and aged.active(now + timedelta(days=30)).name != "old"
    key, salt = aged.from_password("secret", b"salt" * 4)
    assert KeyRing().from_password("secret", salt)[0].secret == key.secret


def test_log_rotates_and_empty_folders_go(spark, tmp_path):
    log = str(tmp_path / "log")
    for i in range(4):
        gone = sinks.write_log(spark.range(10).coalesce(1).withColumn("i", F.lit(i)), log, backups=3)
    assert len(gone) == 1 and spark.read.json(log).count() == 30
    assert len(sinks.write_log(spark.range(5).coalesce(1), log, max_bytes=1)) == 3
    (tmp_path / "x" / "y" / "z").mkdir(parents=True)
    (tmp_path / "x" / "w").mkdir()
    (tmp_path / "x" / "w" / "file").write_text("here")
    assert len(sinks.sweep_empty(spark, str(tmp_path / "x"))) == 2 and (tmp_path / "x" / "w" / "file").exists()


def test_benchmarks(spark):
    ended = []
    plan = Benchmark("plan", lambda df: df.groupBy().count(), setup=lambda s: s.range(100), teardown=ended.append, warmups=1, iterations=4)

    def odd(_, state=[0]):  # noqa: B006
        state[0] += 1
        if state[0] % 2:
            raise RuntimeError("odd")
        return 7

    failing = Benchmark("odd", odd, warmups=0, iterations=4)
    rows = failing.samples(spark).orderBy("iteration").collect()
    assert [r["items"] for r in rows] == [None, 7, None, 7] and rows[0]["error"] == "RuntimeError: odd"
    found = {r["name"]: r["n"] for r in suite(spark, [plan, failing]).collect()}
    assert found == {"plan": 4, "odd": 2} and len(ended) == 1


def test_retention_observers(spark, tmp_path):
    from pyspark.sql import functions as F

    from logweave.operators import retention

    for i in range(6):
        (tmp_path / f"{i}.log").write_text("x")
    rows = [(str(tmp_path / f"{i}.log"), i, 10 * i) for i in range(7)]
    files = spark.createDataFrame(rows, "path string, age_days int, size_bytes int")
    old = retention.Criterion("old", retention.any_of(F.col("age_days") >= 4, F.col("size_bytes").isNull()))
    decided = retention.judged(files, [old, retention.Criterion("odd", F.col("age_days") % 2 == 1)])
    told = []

    def broken(_):
        raise ValueError("deaf")

    import os

    planned = retention.carried_out(decided, os.remove, dry_run=True)
    assert planned.where("event = 'planned'").count() == 5 and len(list(tmp_path.iterdir())) == 6
    events = retention.carried_out(decided, os.remove, {"broken": broken, "list": lambda e: told.extend(e.collect())})
    by = {r["path"].rsplit("/", 1)[-1]: r for r in events.collect()}
    assert {p: r["event"] for p, r in by.items()} == {**{f"{i}.log": "deleted" if i in (1, 3, 4, 5) else "kept" for i in range(6)}, "6.log": "failed", "broken": "observer failed"}
    assert by["5.log"]["reasons"] == ["old", "odd"] and "FileNotFoundError" in by["6.log"]["error"] and by["broken"]["error"] == "ValueError: deaf"
    assert len(told) == 7 and sorted(p.name for p in tmp_path.iterdir()) == ["0.log", "2.log"]


def test_metric_registry(spark):
    import pytest

    from logweave.operators import clusters

    rows = [(i, i % 2, [float(10 * (i % 2)), float(i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["metric"]: r for r in clusters.evaluate(df, ["silhouette", "davies_bouldin", "calinski_harabasz"]).collect()}
    assert got["silhouette"]["value"] > 0.3 and got["davies_bouldin"]["better"] == "lower" and got["silhouette"]["meaning"] == "Good cluster separation"
    one = clusters.evaluate(df.withColumn("label", df["label"] * 0), ["silhouette", "davies_bouldin"]).collect()
    assert all(r["value"] is None and r["meaning"] is None for r in one)
    with pytest.raises(ValueError):
        clusters.evaluate(df, ["unheard"])
