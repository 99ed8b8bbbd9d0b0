"""The registered queries and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logweave.llm import common, pieces, queries, simhash, toxicity


def test_names():
    assert {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxic_filter", "line_dedup", "near_dedup", "mix_sources", "encode_pieces"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())


def test_stages(spark, sf_dir):
    """Each stage works on all that the one before kept, and takes effect."""
    docs = common.read_table(spark, sf_dir, "documents")
    columns = docs.columns
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(common.durable(stage(spark, held[-1], sf_dir), name))
    start, clean, lined, single, mixed, encoded = held
    assert all(h.columns == columns for h in held[:-1])
    scores = toxicity.score(start, toxicity.train(start, common.read_table(spark, sf_dir, "labels")))
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in scores.where("predicted = 0").select("doc_id").collect()}
    assert lined.count() == clean.count()
    assert lined.where("n_chars <> length(text)").count() == 0
    groups = simhash.similar(lined)
    assert {r[0] for r in single.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").collect()}
    assert single.count() == groups.select("component_id").distinct().count()
    assert mixed.select("doc_id").distinct().join(single, "doc_id", "left_anti").count() == 0
    back = pieces.decode(encoded).exceptAll(mixed.select("doc_id", "text"))
    assert encoded.count() == mixed.count() and back.count() == 0


def test_run(spark, sf_dir):
    before = common.unreleased()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = set(common.unreleased()) - set(before)
    assert len(left) == 1 and set(before) <= set(common.unreleased())
    common.release(spark, *left)
    assert common.unreleased() == before


def test_stages_of_nothing(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_leave_little_behind(spark, sf_dir):
    from logweave.llm import lines, simhash

    docs = common.read_table(spark, sf_dir, "documents")
    with common.scope(spark):
        out = lines.drop_boilerplate(docs)
        assert [p.split("/")[-1].split("-")[0] for p in common.unreleased()] == ["drops"]
        assert out.count() == docs.count()
    with common.scope(spark):
        out = simhash.keep_first(docs, find=simhash.similar)
        assert [p.split("/")[-1].split("-")[0] for p in common.unreleased()] == ["marks"]
        assert 0 < out.count() < docs.count()
