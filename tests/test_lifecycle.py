"""Settings, whole analyses, reports, migrations and bundles."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.config import Settings
from logweave.operators import evaluation, hdbscan, report, versions
from logweave.operators.embedding import VectorStore, mock_provider
from logweave.operators.service import Analysis
from logweave.plans import catalog
from logweave.plans.lines import log_lines
from logweave.sources import sinks
from logweave.streaming import jobs


def test_settings():
    s = Settings.from_dict({"novelty": {"threshold": 0.8}, "index": {"kind": "IVF"}})
    assert s.novelty.threshold == 0.8 and s.to_dict()["clustering"]["min_cluster_size"] == 5
    with pytest.raises(ValueError, match="novelty.threshold must be between 0 and 1; clustering.min_cluster_size|clustering.min_cluster_size"):
        Settings.from_dict({"novelty": {"threshold": 2}, "clustering": {"min_cluster_size": 1}})
    with pytest.raises(ValueError, match="no such"):
        Settings.from_dict({"other": {}, "novelty": {"x": 1}})


@pytest.fixture(scope="module")
def records(spark):
    lines = [f"2024-01-15T10:30:{i % 60:02d}Z ERROR Connection timeout to 10.0.0.{i}:5432" for i in range(20)] + [f"[INFO] Request {12345 + i} completed" for i in range(20)] + ["something odd entirely"]
    return spark.createDataFrame([(line, "app.log") for line in lines], "raw string, source string")


def test_analysis(spark, records, tmp_path):
    run = Analysis(Settings(), mock_provider(16))
    rows = run.embedded(records).persist()
    assert rows.count() == 41 and rows.select("normalized").distinct().count() < 41
    one = {tuple(r["embedding"]) for r in rows.where("normalized like 'Connection timeout%'").select("embedding").collect()}
    assert len(one) == 1
    labels, summaries = run.cluster(rows)
    assert labels.count() == 41 and summaries.where("size >= 20").count() >= 1
    novel = {r["id"]: r["score"] for r in run.novel(rows).collect()}
    assert len(novel) == 41 and all(0 <= s <= 1 for s in novel.values())
    store = VectorStore(spark, str(tmp_path / "v"))
    run.store(rows, store)
    assert store.size() == 41
    again = store.save_as(str(tmp_path / "w"), labels.join(rows.select("vec_id", "id"), "vec_id").select("id", "label"))
    assert again.read().where("cluster_id is not null").count() == 41


def test_report(spark):
    clusters = spark.createDataFrame([(i, 100 - i, "ERROR", "<b>") for i in range(25)], "label int, size int, common_level string, common_source string")
    novelty = spark.createDataFrame([(i, 0.5 + i / 100, i > 20) for i in range(40)], "id int, score double, is_novel boolean")
    said = spark.createDataFrame([("High",), ("low",)], "severity string")
    parts = report.collect(report.executive_summary(clusters, novelty, said), clusters, novelty)
    assert parts["summary"] == {"total_clusters": 25, "novel_patterns": 19, "high_severity": 1, "explanations": 2}
    assert len(parts["clusters"]) == 20 and len(parts["novel"]) == 10
    assert json.loads(report.to_json(parts))["summary"]["total_clusters"] == 25
    text = report.to_markdown(parts)
    assert "| Total Clusters | 25 |" in text and "1. **Cluster 0**: 100 logs" in text and "and 9 more" in text
    assert "&lt;b&gt;" in report.to_html(parts) and "<td><b>" not in report.to_html(parts)


def test_migrations(spark, tmp_path):
    log = []

    class Step:
        def __init__(self, name, valid=True):
            self.name, self.valid = name, valid

        def up(self, path):
            log.append(f"+{self.name}")

        def down(self, path):
            log.append(f"-{self.name}")

        def validate(self, path):
            return self.valid

    edges = spark.createDataFrame([("1", "2", "a"), ("2", "3", "b")], "from_version string, to_version string, migration_id string")
    m = versions.Migrator(edges, {"a": Step("a"), "b": Step("b", valid=False)})
    assert m.migrate(str(tmp_path), "1", "3", dry_run=True) == ["a", "b"] and not log
    with pytest.raises(ValueError):
        m.migrate(str(tmp_path), "1", "3")
    assert log == ["+a", "+b", "-b", "-a"]
    with pytest.raises(ValueError):
        m.plan("3", "1")


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "b")
    sinks.export_bundle(spark.range(7), path)
    assert sinks.import_bundle(spark, path).count() == 7
    part = next((tmp_path / "b" / "data").glob("part-*.parquet"))
    (part.parent / f".{part.name}.crc").unlink()  # else the local file system notices first
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="damaged"):
        sinks.import_bundle(spark, path)


def test_embedded_stream(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "message string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message string").parquet(str(tmp_path / "in"))
    jobs.micro_batches(jobs.embedded(stream, mock_provider(4)), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where(F.size("embedding") == 4).count() == 2


def test_sweep_and_session(spark):
    configs = evaluation.sweep("k", [2, 3, 5], 3)
    assert [c["config"] for c in configs] == ["k=3 (baseline)", "k=2", "k=5"]
    pairs = spark.createDataFrame([(str(i),) for i in range(30)], "pair_id string")
    a, b = (evaluation.session_order(pairs, s).orderBy("position").collect() for s in ("s1", "s2"))
    assert [r["position"] for r in a] == list(range(1, 31)) and [r["pair_id"] for r in a] != [r["pair_id"] for r in b]


def test_ingest_queries_use_every_line(spark, sf_dir):
    rows = log_lines(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("line").alias("raw"), "source")
    held = Analysis(Settings(), mock_provider(16)).embedded(rows).select("vec_id", "id", "embedding").toPandas().sort_values("vec_id")
    assert len(held) == rows.count() == 1000
    x = np.stack(held["embedding"].to_numpy()).astype(float)
    labels = hdbscan.fit_predict(x, 5, 3)
    sizes = sorted(np.bincount(labels[labels >= 0]).tolist())
    assert sorted(r["size"] for r in catalog.QUERIES["ingest_and_cluster"](spark, sf_dir).collect()) == sizes
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = np.sort(d, axis=1)[:, :5].mean(1)
    np.fill_diagonal(d, np.inf)
    dense = 1 / (np.sort(d, axis=1)[:, :5].mean(1) + 1e-10)
    z = np.clip((1 / (own + 1e-10) - dense.mean()) / dense.std(), -700, 700)
    want = dict(zip(held["vec_id"], 1 / (1 + np.exp(z))))
    got = {r["id"]: r["score"] for r in catalog.QUERIES["ingest_and_detect"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)
