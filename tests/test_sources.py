"""Sources, sinks and streams over files that the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from logweave.operators.routing import Rule
from logweave.sources import files, sinks, synthetic
from logweave.sources.tail import TailReader, TailSource
from logweave.streaming import jobs


def test_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n\nfour\n")
    (tmp_path / "b.txt").write_text("skipped\n")
    rows = files.read_lines(spark, str(tmp_path), glob="*.log", numbered=True).orderBy("line_num").collect()
    assert [(r["line_num"], r["line"]) for r in rows] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]
    assert files.read_lines(spark, str(tmp_path)).count() == 5
    assert files.discover(spark, str(tmp_path)).count() == 1
    assert files.open_source(spark, str(tmp_path / "a.log")).count() == 4


def test_numbers_across_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text("".join(f"{name} {i} " + "x" * (i % 50) + "\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = files.read_lines(spark, str(tmp_path), numbered=True)
        assert rows.rdd.getNumPartitions() > 4
        wrong = rows.where(F.concat(F.substring("source", -5, 1), F.lit(" "), (F.col("line_num") - 1).cast("string"), F.lit(" ")) != F.regexp_extract("line", r"^\w \d+ ", 0))
        assert rows.count() == 40_000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_log_and_golden(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"timestamp": "2024-01-15T10:00:00Z", "level": "error", "duration": "2.5s"}\n{"duration": "500ms"}\nbroken\n')
    rows = files.read_log(spark, str(tmp_path / "x.json")).collect()
    assert sorted(r["seconds"] for r in rows if r["seconds"] is not None) == [0.5, 2.5]
    for v in ("1.0", "1.1"):
        (tmp_path / f"set_v{v}.json").write_text(json.dumps({"records": [{"id": v, "message": "m"}], "expected_clusters": [{"id": "c", "name": "n"}]}))
    records, clusters, version = files.read_golden(spark, str(tmp_path), "set")
    assert version == "1.1" and records.first()["id"] == "1.1" and clusters.count() == 1
    with pytest.raises(Exception):
        files.read_golden(spark, str(tmp_path), "other")


def test_tail_offsets(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("1\n2\n3\nhalf")
    r = TailReader({"path": str(tmp_path), "maxLines": "2"})
    start = r.initialOffset()

    def take(begin, end):
        return [line for p in r.partitions(begin, end) for line, _, _ in r.read(p)]

    first = r.latestOffset()
    assert take(start, first) == ["1", "2"]
    second = r.latestOffset()
    assert take(first, second) == ["3"]
    log.write_text("1\n2\n3\nhalf more\n")
    third = r.latestOffset()
    assert take(second, third) == ["half more"]
    log.write_text("new\n")
    assert take(third, r.latestOffset()) == ["new"]


def test_tail_goes_on_from_a_checkpoint(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("1\n2\n3\n4\n")
    first = TailReader({"path": str(tmp_path), "maxLines": "3"})
    first.initialOffset()
    done = first.latestOffset()
    with log.open("a") as f:
        f.write("5\n" * 9 + "half")
    # A reader of a restarted query isn't asked for the initial offset.
    again = TailReader({"path": str(tmp_path), "maxLines": "2"})
    end = again.latestOffset()
    assert [line for p in again.partitions(done, end) for line, _, _ in again.read(p)] == ["4", *["5"] * 9]
    with log.open("a") as f:
        f.write(" more\n6\n7\n")
    assert [line for p in again.partitions(end, again.latestOffset()) for line, _, _ in again.read(p)] == ["half more", "6"]


def _taken(reader, begin, end):
    return [line for p in reader.partitions(begin, end) for line, _, _ in reader.read(p)]


def test_tail_renamed_and_regrown(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("1\n2\n3\nlast")
    r = TailReader({"path": str(tmp_path), "maxLines": "2"})
    at, got = r.initialOffset(), []

    def poll():
        nonlocal at
        end = r.latestOffset()
        got.append(_taken(r, at, end))
        at = end

    poll()
    # Renamed, and begun anew with more than the old offset; the writer's last words go to the old file.
    log.rename(tmp_path / "a.log.1")
    with (tmp_path / "a.log.1").open("a") as f:
        f.write(" words")
    log.write_text("new 1\nnew 2\nnew 3\n")
    (tmp_path / "b.log.7").write_text("never followed\n")
    for _ in range(4):
        poll()
    assert got[0] == ["1", "2"]
    assert [x for part in got[1:] for x in part] == ["3", "last words", "new 1", "new 2", "new 3"]


def test_tail_renamed_while_stopped(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("1\n2\n")
    first = TailReader({"path": str(tmp_path)})
    begin = first.initialOffset()
    done = first.latestOffset()
    assert _taken(first, begin, done) == ["1", "2"]
    with log.open("a") as f:
        f.write("3\n")
    log.rename(tmp_path / "a.log.1")
    log.write_text("one much longer line than those before\n")
    (tmp_path / "old.log.9").write_text("never followed\n")
    again = TailReader({"path": str(tmp_path)})
    end = again.latestOffset()
    assert sorted(_taken(again, done, end)) == ["3", "one much longer line than those before"]
    assert _taken(again, end, again.latestOffset()) == []


def test_tail_copied_and_truncated(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("first 1\nfirst 2\n")
    r = TailReader({"path": str(tmp_path)})
    begin = r.initialOffset()
    one = r.latestOffset()
    assert _taken(r, begin, one) == ["first 1", "first 2"]
    # The same inode, already longer than what was read of it.
    log.write_text("second 1\nsecond 2\nsecond 3\n")
    two = r.latestOffset()
    assert _taken(r, one, two) == ["second 1", "second 2", "second 3"]
    log.write_text("x\n")
    assert _taken(r, two, r.latestOffset()) == ["x"]


def test_tail_renamed_before_it_is_read(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("1\n")
    r = TailReader({"path": str(log)})
    begin = r.initialOffset()
    end = r.latestOffset()
    spans = r.partitions(begin, end)
    log.rename(tmp_path / "a.log.1")
    assert [line for p in spans for line, _, _ in r.read(p)] == ["1"]
    (tmp_path / "a.log.1").unlink()
    with pytest.raises(FileNotFoundError):
        list(r.read(spans[0]))
    assert list(TailReader({"path": str(log), "failOnDataLoss": "false"}).read(spans[0])) == []


def test_rotating_writer_yields_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    spark.dataSource.register(TailSource)

    def run():
        lines = spark.readStream.format("logweave-tail").option("path", str(logs)).option("maxLines", "15").load()
        query = lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        return query

    n = 0
    for part in range(3):
        query = run() if part else None
        for _ in range(3):
            with (logs / "a.log").open("a") as f:
                f.writelines(f"line {n + i}\n" for i in range(40))
            n += 40
            if query:
                query.processAllAvailable()
            (logs / "a.log").rename(logs / f"a.log.{n}")
            (logs / "a.log").write_text(f"line {n}\n")
            n += 1
        if query:
            query.processAllAvailable()
            query.stop()
    run().stop()
    got = sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # What was rotated away before the first start was never followed; the rest is there once.
    assert len(got) == len(set(got)) and set(got) >= {f"line {i}" for i in range(122, n)}


def test_long_lines_are_errors(spark, tmp_path):
    (tmp_path / "long.log").write_text("short\n" + "x" * (files.MAX_LINE + 1) + "\n")
    with pytest.raises(Exception, match="line too long"):
        files.read_lines(spark, str(tmp_path)).collect()


def test_tail_stream_to_alerts(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.log").write_text("ERROR one\nfine\n")
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("logweave-tail").option("path", str(logs)).load()
    score = lambda c: F.when(c.contains("ERROR"), 0.95).otherwise(0.1)

    def run():
        jobs.watch_and_route(
            lines, [Rule("all", ["slack"], least_priority="high")], lambda b: b.select("message", "target").write.mode("append").json(str(out)), str(tmp_path / "cp"), score, seconds=None
        ).awaitTermination()

    run()
    with (logs / "a.log").open("a") as f:
        f.write("ERROR two\n")
    run()
    got = sorted((r["message"], r["target"]) for r in spark.read.json(str(out)).collect())
    assert got == [("one", "slack"), ("two", "slack")]


def test_stopped_stream_yields_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    spark.dataSource.register(TailSource)

    def run():
        lines = spark.readStream.format("logweave-tail").option("path", str(logs)).option("maxLines", "20").load()
        query = lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    for part in range(3):
        with (logs / "a.log").open("a") as f:
            f.writelines(f"line {part} {i}\n" for i in range(50))
        run()
    got = sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(f"line {part} {i}" for part in range(3) for i in range(50))


def test_dead_letters(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

    def fail(batch, number):
        raise RuntimeError("no")

    q = jobs.micro_batches(stream, fail, str(tmp_path / "cp"), None, str(tmp_path / "dead"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "dead")).count() == 5
    assert jobs.status(q)["active"] is False


def test_synthetic_is_repeatable(spark):
    a = synthetic.generate(spark, 500, seed=1).collect()
    assert a == synthetic.generate(spark, 500, seed=1).repartition(7).orderBy("id").collect()
    assert {r["level"] for r in a} == set(synthetic.LEVEL_WEIGHTS)


def test_snapshots(spark, tmp_path):
    shots = sinks.Snapshots(spark, str(tmp_path / "s"))
    name = shots.create(spark.range(10), "first")
    assert shots.restore(name).count() == 10 and shots.list().first()["id"] == name
    part = next((tmp_path / "s" / "data" / name).glob("part-*.parquet"))
    part.unlink()
    with pytest.raises(ValueError):
        shots.restore(name)
    with pytest.raises(ValueError):
        shots.restore("../x")


def test_notify(spark):
    def send(event):
        if event["event_id"] == "2":
            raise OSError("down")

    got = {r["event_id"]: (r["status"], r["attempts"]) for r in sinks.notify(spark.createDataFrame([("1",), ("2",)], "event_id string"), send, 2, 0.0).collect()}
    assert got == {"1": ("sent", 1), "2": ("failed", 2)}


def test_spread(spark, tmp_path):
    from logweave.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(12).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Repartition" in plan(spread(one)) and "Repartition" not in plan(spread(many))
    assert spread(one).count() == 100
