"""Whole analyses, reports, sessions, record joins and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import changelog, evaluation, report
from ..operators.embedding import mock_provider
from ..operators.service import Analysis
from ..session import held, read_table, spread
from .lines import LINES_SQL, log_lines
from .registry import query
from .vectors import vecs


def _analysis(spark, sf_dir):
    rows = log_lines(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("line").alias("raw"), "source")
    settings = Settings.from_dict({"clustering": {"min_cluster_size": 5}, "novelty": {"k": 5}})
    run = Analysis(settings, mock_provider(16))
    # Held, else printing, parsing and masking are folded into one expression of enormous size.
    return run, held(run.embedded(held(spread(rows))))


@query()
def ingest_and_cluster(spark, sf_dir):
    run, records = _analysis(spark, sf_dir)
    _, found = run.cluster(records)
    return found.select("label", "size", "common_level", "common_source")


@query()
def ingest_and_detect(spark, sf_dir):
    run, records = _analysis(spark, sf_dir)
    return run.novel(records).select("id", F.round("score", 4).alias("score"), "is_novel")


@query("""SELECT (SELECT count(DISTINCT label) FROM embeddings) AS total_clusters, count(*) FILTER (value / 500 >= 0.7) AS novel_patterns, count(*) FILTER (event_type = 'error') AS high_severity, count(*) AS explanations FROM events""")
def report_summary(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    sizes = read_table(spark, sf_dir, "embeddings").groupBy("label").count()
    return report.executive_summary(sizes, e.select((F.col("value") / 500 >= 0.7).alias("is_novel")), e.select(F.when(F.col("event_type") == "error", "HIGH").otherwise("low").alias("severity")))


@query("""SELECT vec_id AS case_no, array_to_string(list_filter([CASE WHEN s < 0.25 THEN 'Low silhouette score indicates poor cluster separation. Consider adjusting min_cluster_size or min_samples parameters.' END,
CASE WHEN d > 2 THEN 'High Davies-Bouldin index suggests clusters may be overlapping. Try increasing cluster_selection_epsilon.' END,
CASE WHEN r > 0.3 THEN 'High noise ratio (' || format('{:.1f}', r * 100) || '%). Consider lowering min_cluster_size to capture more patterns.' END,
CASE WHEN st IN ('failed', 'degraded') THEN 'Regression test ' || st || '. Review misclassified records and consider retraining.' END,
CASE WHEN n > 0 THEN 'Found ' || n || ' new clusters. Update golden dataset if these represent valid patterns.' END], lambda x: x IS NOT NULL), ' / ') AS said
FROM (SELECT vec_id, vec_id % 10 / 10.0::DOUBLE AS s, vec_id % 7 / 2.0::DOUBLE AS d, vec_id % 8 / 10.0::DOUBLE AS r, CASE vec_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'passed' END AS st, vec_id % 4 AS n FROM embeddings)""")
def recommendations(spark, sf_dir):
    i = F.col("vec_id")
    status = F.when(i % 3 == 0, "FAILED").when(i % 3 == 1, "DEGRADED").otherwise("PASSED")
    said = report.recommendations(i % 10 / F.lit(10.0), i % 7 / F.lit(2.0), i % 8 / F.lit(10.0), status, i % 4)
    return read_table(spark, sf_dir, "embeddings").select(i.alias("case_no"), F.array_join(said, " / ").alias("said"))


@query("""SELECT user_id, CASE WHEN avg((event_type = 'error')::INTEGER) > 0.5 THEN 3 ELSE 2 END AS n FROM events GROUP BY user_id""")
def privacy_recommendations(spark, sf_dir):
    by = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("int")).alias("rate"))
    return by.select("user_id", F.size(report.privacy_recommendations("enhanced", False, 90, "store_redacted", F.col("rate"))).alias("n"))


@query("SELECT v.vec_id AS id, d.source, len(v.embedding)::INTEGER AS dim FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id")
def records_with_embeddings(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source").join(e, "id")


@query("WITH g AS (SELECT vec_id AS id, label AS expected FROM embeddings WHERE vec_id % 3 <> 0), a AS (SELECT vec_id AS id, label % 7 AS actual FROM embeddings WHERE vec_id % 2 = 0) SELECT id, expected, actual, expected = actual AS same FROM g JOIN a USING (id)")
def golden_labels(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings")
    g = v.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), F.col("label").alias("expected"))
    return g.join(v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("label") % 7).alias("actual")), "id").withColumn("same", F.col("expected") == F.col("actual"))


@query("SELECT 1000 + row_number() OVER (ORDER BY event_id) - 1 AS index_id, event_id AS id FROM events WHERE event_type = 'error'")
def append_ids(spark, sf_dir):
    """Running ids of appended rows, after those there are: ranked within ranges, so that no task has all rows."""
    rows = read_table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    ranged = rows.withColumn("part", F.floor(F.col("id") / 10000))
    before = ranged.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return ranged.join(before, "part").select((1000 + F.col("start") + rank - 1).alias("index_id"), "id")


@query("SELECT DISTINCT event_type AS label FROM events UNION SELECT 'label-' || quality FROM labels")
def label_union(spark, sf_dir):
    a = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("label"))
    return a.union(read_table(spark, sf_dir, "labels").select(F.concat(F.lit("label-"), F.col("quality").cast("string")))).distinct()


@query("SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0)")
def label_intersection(spark, sf_dir):
    x = read_table(spark, sf_dir, "labels")
    return x.where("quality = 1").select("doc_id").intersect(x.where("toxic = 0").select("doc_id"))


@query("SELECT DISTINCT least(user_id, event_id % 50) || '-' || greatest(user_id, event_id % 50) AS pair FROM events WHERE user_id <> event_id % 50")
def pair_dedup(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("other")).where("user_id <> other")
    return e.select(F.concat_ws("-", F.least("user_id", "other").cast("string"), F.greatest("user_id", "other").cast("string")).alias("pair")).dropDuplicates()


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(date_trunc('second', ts))::BIGINT AS seconds, date_trunc('hour', ts) AS hour, floor((epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts))) / 86400)::BIGINT AS age_days FROM events""")
def date_functions(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    end = F.unix_timestamp(F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), seconds.alias("seconds"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.floor((end - seconds) / 86400).alias("age_days"),
    )


@query("""SELECT doc_id, lower(substr(text, 1, 20)) AS head, trim(substr(text, 1, 200)) AS preview, starts_with(text, 'T') AS starts, contains(text, 'the') AS has FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", F.lower(F.substring(t, 1, 20)).alias("head"), F.trim(F.substring(t, 1, 200)).alias("preview"), t.startswith("T").alias("starts"), t.contains("the").alias("has"))


@query("""SELECT event_id AS id, json_extract_string(props, '$.k')::INTEGER AS k, event_type || ',' || 'x' || CASE WHEN event_type = 'error' THEN ',bad' ELSE '' END AS tags FROM events""")
def collection_functions(spark, sf_dir):
    tags = F.array_distinct(F.array_compact(F.array(F.col("event_type"), F.lit("x"), F.when(F.col("event_type") == "error", "bad"), F.lit("x"))))
    merged = F.map_concat(F.create_map(F.lit("a"), F.lit(1)), F.from_json("props", "map<string,int>"))
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), merged["k"].alias("k"), F.array_join(tags, ",").alias("tags"))


@query("SELECT event_id::VARCHAR AS sha, 'Ann' AS author, 'Added' AS entry_type, 'a|b ' || user_id AS description FROM events WHERE event_type = 'click'")
def git_log(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    line = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_type") == "click", "|feat: a|b ").otherwise("|a|b "), F.col("user_id").cast("string"), F.lit("|Ann"))
    return changelog.parse_git_log(e.select(line.alias("line"))).select("sha", "author", "entry_type", "description")


@query("""SELECT (SELECT count(*) FROM events) AS total, count(*) FILTER (user_id % 3 = 0) AS labelled, count(*) FILTER (user_id % 6 = 0) AS skipped, count(*) FILTER (user_id % 3 <> 0) AS remaining, round(100.0::DOUBLE * count(*) FILTER (user_id % 3 = 0) / count(*), 2) AS percent FROM events""")
def session_progress(spark, sf_dir):
    pairs = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("pair_id"), "user_id")
    labels = pairs.where("user_id % 3 = 0").select("pair_id", F.when(F.col("user_id") % 6 == 0, "skip").otherwise("same").alias("label"))
    return evaluation.session_progress(pairs, labels)


@query("SELECT session, count(*) AS pairs, 1::BIGINT AS first, count(*) AS last, count(*) AS places, true AS shuffled FROM labels, (VALUES ('s1'), ('s2')) AS t(session) GROUP BY session")
def session_permutations(spark, sf_dir):
    """A session's order holds every place once and isn't that of the ids."""
    pairs, out = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair_id")), None
    for session in ("s1", "s2"):
        rows = evaluation.session_order(pairs, session)
        one = rows.agg(
            F.lit(session).alias("session"), F.count("*").alias("pairs"), F.min("position").alias("first"), F.max("position").alias("last"),
            F.count_distinct("position").alias("places"), (F.corr("pair_id", "position") < 0.5).alias("shuffled"),
        )
        out = one if out is None else out.unionAll(one)
    return out


@query()
def session_order(spark, sf_dir):
    pairs = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair_id"))
    return evaluation.session_order(pairs, "s1").select("pair_id", "position")


@query("""SELECT config, count(*) AS n_runs, avg(k)::DOUBLE AS mean_quality FROM (VALUES ('k=4 (baseline)', 4), ('k=8', 8), ('k=12', 12)) AS t(config, k), range(3) GROUP BY config""")
def ablation_sweep(spark, sf_dir):
    from ..operators import clusters

    def measure(data, config, seed):
        labels = clusters.mock_labels(data, config["k"])
        return labels.agg(F.count_distinct("label").alias("quality"))

    out = evaluation.run_ablation(vecs(spark, sf_dir), evaluation.sweep("k", [4, 8, 12], 4), measure)
    return evaluation.ablation_summary(out).select("config", "n_runs", "mean_quality")


@query(f"""WITH {LINES_SQL} SELECT source, count(*) AS records, count(*) FILTER (id % 10 > 0) AS processed, count(*) FILTER (id % 10 = 0) AS dropped, count(DISTINCT id // 100) AS batches FROM log_lines GROUP BY source""")
def batch_metrics(spark, sf_dir):
    return log_lines(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("records"), F.count_if(F.col("id") % 10 > 0).alias("processed"), F.count_if(F.col("id") % 10 == 0).alias("dropped"), F.count_distinct(F.floor(F.col("id") / 100)).alias("batches")
    )


@query("""SELECT event_id AS attempt_id, event_id % 4 + 1 AS attempt, pow(2.0, event_id % 4) AS delay FROM events""")
def retry_delays(spark, sf_dir):
    from ..operators.routing import retry_delay

    n = F.col("event_id") % 4 + 1
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), n.alias("attempt"), retry_delay(n).alias("delay"))
