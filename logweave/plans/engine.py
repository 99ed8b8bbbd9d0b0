"""Clustering, embedding, index, source and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import embedding, index, hdbscan as density, knn
from ..operators.preprocess import with_stats
from ..session import read_table, scratch
from ..sources import synthetic
from ..streaming import jobs
from .lines import LINES_SQL, log_lines
from .registry import query


@query()
def hdbscan(spark, sf_dir):
    """Density clusters of the embeddings pulled towards their labels' own axes, so that there is something to find."""
    e = read_table(spark, sf_dir, "embeddings")
    pulled = e.select("vec_id", F.transform("embedding", lambda x, i: x.cast("double") * 0.3 + F.when(i == F.col("label"), 3.0).otherwise(0.0)).alias("embedding"))
    return density.cluster(pulled, min_cluster_size=5, min_samples=3)


@query()
def embed_mock(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    made = embedding.embed_records(docs, embedding.mock_provider(32))
    return made.select("doc_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("SELECT doc_id, 1.0::DOUBLE AS norm, 32 AS size, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def embed_mock_norms(spark, sf_dir):
    """Every vector has length one, and equal texts have equal vectors, other texts others."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    made = embedding.embed_records(docs, embedding.mock_provider(32, seed_bytes=32)).select("doc_id", "embedding")
    same = made.groupBy(F.xxhash64("embedding").alias("h")).agg(F.count("*").alias("copies"))
    rows = made.withColumn("h", F.xxhash64("embedding")).join(same, "h")
    return rows.select("doc_id", F.round(V.norm(F.col("embedding")), 4).cast("double").alias("norm"), F.size("embedding").alias("size"), "copies")


@query("""SELECT count(DISTINCT text) AS embedded, count(DISTINCT text) AS keys, count(DISTINCT text) AS vectors, 1.0::DOUBLE AS shortest, 1.0::DOUBLE AS longest FROM documents""")
def embed_distinct(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    known = embedding.embed_distinct(docs, "message", embedding.mock_provider(16, seed_bytes=32))
    norm = F.round(V.norm(F.col("embedding")), 4).cast("double")
    return known.agg(
        F.count("*").alias("embedded"), F.count_distinct("text_key").alias("keys"), F.count_distinct(F.xxhash64("embedding")).alias("vectors"),
        F.min(norm).alias("shortest"), F.max(norm).alias("longest"),
    )


@query("""WITH t AS (SELECT doc_id, text, substr(sha256(text), 1, 16) AS k FROM documents) SELECT doc_id, k IN (SELECT k FROM t WHERE doc_id % 2 = 0) AS hit FROM t""")
def cache_lookup(spark, sf_dir):
    t = read_table(spark, sf_dir, "documents").select("doc_id", embedding.text_key(F.col("text")).alias("k"))
    known = t.where("doc_id % 2 = 0").select("k").distinct()
    hits = t.join(known, "k", "left_semi").select("doc_id", F.lit(True).alias("hit"))
    return hits.unionAll(t.join(known, "k", "left_anti").select("doc_id", F.lit(False).alias("hit")))


@query(f"""WITH {LINES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN line WHEN id % 3 = 1 THEN event_type ELSE line END AS text FROM log_lines""")
def embed_text_choice(spark, sf_dir):
    normalized = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.col("event_type"))
    return log_lines(spark, sf_dir).select("id", embedding.chosen_text(normalized, F.col("line")).alias("text"))


EXACT = """WITH hits AS (SELECT q.vec_id AS query_id, e.vec_id AS ref_id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))) AS d2
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, ref_id)::INTEGER AS rank FROM hits)
SELECT query_id, rank, ref_id, round(d2, 4) AS d2 FROM ranked WHERE rank <= 5"""


def _searched(spark, sf_dir, kind, how=None, **settings):
    """Filled in two parts, copied, opened again and searched."""
    e = read_table(spark, sf_dir, "embeddings")
    made = index.index(kind, spark, **settings).train(e).add(e.where("vec_id % 3 = 0")).add(e.where("vec_id % 3 <> 0"))
    opened = made.save_as(f"{scratch(spark)}/copy")
    return opened.search(e.where("vec_id % 50 = 0"), 5, **(how or {})).select("query_id", "rank", "ref_id", F.round("d2", 4).alias("d2"))


@query(EXACT)
def flat_index_search(spark, sf_dir):
    return _searched(spark, sf_dir, "Flat")


@query(EXACT)
def ivf_search_all_cells(spark, sf_dir):
    """With every cell probed nothing is missed."""
    return _searched(spark, sf_dir, "IVFFlat", lists=20, probes=20, recall=None)


@query()
def ivf_search(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    made = index.index("IVFFlat", spark, lists=20, probes=8).train(e).add(e)
    return made.search(e.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "ref_id", F.round("d2", 4).alias("d2"))


@query(EXACT)
def graph_search(spark, sf_dir):
    """With a beam this wide a walk over vectors like these finds what an exact search does."""
    return _searched(spark, sf_dir, "HNSW", {"beam": 256}, m=32)


def _reached(spark, sf_dir, kind, recall, **settings):
    e = read_table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    near = index.index(kind, spark, **settings).train(e).add(e).search(asked, 5).select("query_id", "ref_id")
    found = knn.nearest(asked, e, 5).join(near.withColumn("hit", F.lit(1)), ["query_id", "ref_id"], "left")
    return found.agg((F.avg(F.coalesce("hit", F.lit(0))) >= recall).alias("reached"), F.count_distinct("query_id").alias("asked"))


@query("SELECT true AS reached, count(*) FILTER (vec_id % 50 = 0) AS asked FROM embeddings")
def ivf_recall(spark, sf_dir):
    """Whether the approximate index finds nine in ten of the exact neighbours."""
    return _reached(spark, sf_dir, "IVFFlat", 0.9, lists=20, probes=8)


@query("SELECT true AS reached, count(*) FILTER (vec_id % 50 = 0) AS asked FROM embeddings")
def graph_recall(spark, sf_dir):
    return _reached(spark, sf_dir, "HNSW", 0.95, m=32, lowest=32, beam=16)


@query("SELECT count(*) AS rows, min(vec_id) AS first, max(vec_id) AS last, true AS all_cells FROM embeddings")
def index_stats(spark, sf_dir):
    """Rows by cell, of an index that was cleared and filled again."""
    e = read_table(spark, sf_dir, "embeddings")
    made = index.index("IVFFlat", spark, lists=20).train(e).add(e)
    made.clear()
    ends = made.add(e).blocks().agg(F.min("least").alias("first"), F.max("most").alias("last"))
    cells = made.stats().agg(F.sum("rows").alias("rows"), (F.count("*") == 20).alias("all_cells"))
    return cells.join(ends, F.lit(True)).select("rows", "first", "last", "all_cells")


@query("""SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 3 = 0 THEN 100 + label WHEN vec_id % 2 = 0 THEN label END AS cluster_id, substr('vector ' || vec_id, 1, 200) AS message_preview FROM embeddings""")
def vector_store_update(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    store = embedding.VectorStore(spark, f"{scratch(spark)}/store")
    store.add(e.select("vec_id", F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("message"), F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("cluster_id")))
    labels = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + 100).alias("label"))
    return store.with_clusters(labels).select("id", "cluster_id", "message_preview")


@query()
def synthetic_logs(spark, sf_dir):
    return synthetic.generate(spark, 2000).groupBy("pattern", "level").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS output, count(*) AS parsed, count(*) FILTER (event_type = 'error') AS levelled FROM events")
def preprocess_stats(spark, sf_dir):
    lines = log_lines(spark, sf_dir).select("id", F.col("line").alias("message"), F.when(F.col("event_type") == "error", "ERROR").alias("level"))
    seen_df, seen = with_stats(lines, f"preprocess-{uuid.uuid4().hex}")
    seen_df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["output"], got["parsed"], got["levelled"])], "output long, parsed long, levelled long")


def _event_stream(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _into_memory(stream, mode: str):
    name = f"logweave_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{scratch(stream.sparkSession)}/checkpoint").start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS total_logs FROM events GROUP BY 1")
def stream_hourly(spark, sf_dir):
    events = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _into_memory(jobs.windowed_volume(events), "complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "total_logs")


@query("""SELECT 'Novel pattern: ' || event_type || ' by ' || user_id AS title, CASE WHEN value / 500 >= 0.9 THEN 'critical' WHEN value / 500 >= 0.7 THEN 'high' ELSE 'medium' END AS priority, count(*) AS n FROM events WHERE value / 500 >= 0.5 GROUP BY ALL""")
def stream_alerts(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select(
        F.concat_ws(" by ", "event_type", F.col("user_id").cast("string")).alias("message"), (F.col("value") / 500).alias("score"), F.lit("app").alias("source")
    )
    from ..operators.routing import events_from_scores

    out = _into_memory(events_from_scores(events, 0.5), "append")
    return out.groupBy("title", "priority").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS processed FROM events""")
def stream_micro_batches(spark, sf_dir):
    folder = scratch(spark)
    q = jobs.micro_batches(_event_stream(spark, sf_dir).select("event_id"), lambda batch, n: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint", seconds=None)
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("processed"))
