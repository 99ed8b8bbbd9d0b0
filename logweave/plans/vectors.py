"""Vector search, novelty, cluster and evaluation queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters, evaluation, knn, novelty
from ..session import read_table
from .registry import query

D2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: pow({a}[i]::DOUBLE - {b}[i]::DOUBLE, 2)))"
VECS = """vecs AS (SELECT vec_id, embedding AS v, CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label END AS label FROM embeddings)"""


def vecs(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 17 == 0, -1).otherwise(F.col("label")))


def split(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0")


def d2(a, b):
    return D2.format(a=a, b=b)


@query(f"""SELECT e.vec_id AS id, round({d2('e.embedding', 'q.embedding')}, 4) AS distance, round(greatest(0, 1 - {d2('e.embedding', 'q.embedding')} / 2), 4) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {d2('e.embedding', 'q.embedding')}, e.vec_id LIMIT 10""")
def vector_topk(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 7").first()["embedding"]
    return knn.search(e, probe, 10).select("id", F.round("distance", 4).alias("distance"), F.round("similarity", 4).alias("similarity"))


BATCH = f"""hits AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {d2('e.embedding', 'q.embedding')} AS d2 FROM embeddings q, embeddings e WHERE q.vec_id % 5 = 0 AND e.vec_id % 5 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id)::INTEGER AS rank FROM hits)"""


@query(f"WITH {BATCH} SELECT query_id, rank, id, round(d2, 4) AS distance, round(greatest(0, 1 - d2 / 2), 4) AS similarity FROM ranked WHERE rank <= 5")
def vector_topk_batch(spark, sf_dir):
    q, r = split(spark, sf_dir)
    return knn.search_batch(r, q, 5).select("query_id", "rank", "id", F.round("distance", 4).alias("distance"), F.round("similarity", 4).alias("similarity"))


@query(f"WITH {BATCH} SELECT query_id, id, round(greatest(0, 1 - d2 / 2), 4) AS similarity FROM ranked WHERE rank <= 20 AND greatest(0, 1 - d2 / 2) >= 0.25")
def min_similarity_search(spark, sf_dir):
    q, r = split(spark, sf_dir)
    return knn.search_batch(r, q, 20, min_similarity=0.25).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {BATCH} SELECT query_id, r.id, round(d2, 4) AS distance, d.source, CASE WHEN d.doc_id IS NULL THEN 'unknown' ELSE d.lang END AS lang FROM ranked r LEFT JOIN documents d ON d.doc_id = r.id + 700 WHERE rank <= 3")
def search_with_metadata(spark, sf_dir):
    q, r = split(spark, sf_dir)
    meta = read_table(spark, sf_dir, "documents").select((F.col("doc_id") - 700).alias("id"), "source", "lang")
    hits = knn.with_metadata(knn.search_batch(r, q, 3), meta)
    return hits.select("query_id", "id", F.round("distance", 4).alias("distance"), "source", F.coalesce("lang", F.lit("unknown")).alias("lang"))


FIT = f"""near AS (SELECT a.vec_id AS id, sqrt({d2('a.embedding', 'b.embedding')}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {d2('a.embedding', 'b.embedding')}, b.vec_id) AS r
  FROM embeddings a, embeddings b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 <> 0 AND a.vec_id <> b.vec_id),
base AS (SELECT id, avg(d) AS mean_distance, 1 / (avg(d) + 1e-10) AS density FROM near WHERE r <= 5 GROUP BY id),
fitted AS (SELECT avg(density) AS mu, stddev_pop(density) AS sd, avg(mean_distance) AS mu_d, stddev_pop(mean_distance) AS sd_d FROM base)"""
SCORE = f"""{FIT}, far AS (SELECT a.vec_id AS id, sqrt({d2('a.embedding', 'b.embedding')}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {d2('a.embedding', 'b.embedding')}, b.vec_id) AS r
  FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
means AS (SELECT id, avg(d) AS m FROM far WHERE r <= 5 GROUP BY id),
scored AS (SELECT id, 1 / (1 + exp((1 / (m + 1e-10) - mu) / sd)) AS score, 1 / (1 + exp(-(m - mu_d) / sd_d)) AS distance_score FROM means, fitted)"""


@query(f"WITH {FIT} SELECT id, round(mean_distance, 4) AS mean_distance, round(density, 4) AS density FROM base")
def knn_density_fit(spark, sf_dir):
    _, r = split(spark, sf_dir)
    return novelty.baseline_rows(r, 5).select("id", F.round("mean_distance", 4).alias("mean_distance"), F.round("density", 4).alias("density"))


def _scored(spark, sf_dir, use_density=True):
    q, r = split(spark, sf_dir)
    return novelty.score(q, r, novelty.fit(r, 5, use_density))


@query(f"WITH {SCORE} SELECT id, round(score, 4) AS score FROM scored")
def novelty_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", F.round("score", 4).alias("score"))


@query(f"WITH {SCORE} SELECT id, round(distance_score, 4) AS score FROM scored")
def novelty_score_distance(spark, sf_dir):
    return _scored(spark, sf_dir, False).select("id", F.round("score", 4).alias("score"))


@query(f"""WITH {SCORE} SELECT id, round(score, 4) AS score, score >= 0.7 AS is_novel, CASE WHEN score >= 0.7 THEN format('This log pattern is {{}} (score: {{:.3f}}, threshold: {{:.3f}}, margin: {{:.3f}}). It appears in a low-density region of the embedding space, indicating deviation from established patterns.',
CASE WHEN score >= 0.9 THEN 'highly unusual' WHEN score >= 0.8 THEN 'unusual' ELSE 'moderately unusual' END, score, 0.7::DOUBLE, score - 0.7::DOUBLE) END AS explanation FROM scored""")
def novelty_detect(spark, sf_dir):
    return novelty.detect(_scored(spark, sf_dir)).select("id", F.round("score", 4).alias("score"), "is_novel", "explanation")


@query(f"WITH {SCORE} SELECT id, round(score, 4) AS score FROM scored WHERE score >= 0.7 ORDER BY score DESC, id LIMIT 10")
def novelty_top10(spark, sf_dir):
    return _scored(spark, sf_dir).where("score >= 0.7").orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 4).alias("score"))


@query(f"""WITH {SCORE} SELECT count(*) AS n_samples, count(*) FILTER (score >= 0.7) AS n_novel, count(*) FILTER (score < 0.7) AS n_normal, round(avg((score >= 0.7)::INTEGER), 4) AS novelty_rate,
round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS std_score, round(min(score), 4) AS min_score, round(max(score), 4) AS max_score FROM scored""")
def novelty_stats(spark, sf_dir):
    return novelty.stats(novelty.detect(_scored(spark, sf_dir)))


@query("""WITH n AS (SELECT vec_id AS id, sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE * (1 + vec_id % 7), 2)))) AS norm FROM embeddings)
SELECT id, round((norm - (SELECT min(norm) FROM n)) / ((SELECT max(norm) FROM n) - (SELECT min(norm) FROM n)), 4) AS score FROM n""")
def novelty_mock(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    scaled = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("embedding"))
    return novelty.mock_score(scaled).select("id", F.round("score", 4).alias("score"))


@query("""SELECT event_id AS id, round(avg(value) OVER w, 9) AS running_mean, max(value) OVER w AS running_max, min(value) OVER w AS running_min FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def novelty_running_stats(spark, sf_dir):
    rows = novelty.running_stats(read_table(spark, sf_dir, "events"), "event_id", "value", by="user_id")
    return rows.select(F.col("event_id").alias("id"), F.round("running_mean", 9).alias("running_mean"), "running_max", "running_min")


@query("""WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s)
SELECT id, round(norm, 4) AS norm, round(list_sum(v) / len(v), 4) + 0 AS mean, round(v[1] / norm, 4) + 0 AS first, round(list_sum(list_transform(v, lambda x: x / norm * x)), 4) AS along FROM n""")
def vector_functions(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    v = F.col("v")
    rows = e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("v"))
    return rows.select(
        "id", F.round(V.norm(v), 4).alias("norm"), (F.round(V.mean(v), 4) + 0.0).alias("mean"), (F.round(V.normalized(v)[0], 4) + 0.0).alias("first"),
        F.round(V.dot(V.normalized(v), v), 4).alias("along"),
    )


# Clusters

CENTRES = f"""{VECS}, cells AS (SELECT label, i, avg(v[i]::DOUBLE) AS m FROM vecs, unnest(range(1, 65)) AS t(i) WHERE label >= 0 GROUP BY label, i),
centres AS (SELECT label, list(m ORDER BY i) AS c FROM cells GROUP BY label), sizes AS (SELECT label, count(*) AS size FROM vecs WHERE label >= 0 GROUP BY label),
members AS (SELECT v.vec_id AS id, v.label, v.v, c.c, sqrt({d2('v.v', 'c.c')}) AS d FROM vecs v JOIN centres c USING (label))"""


@query(f"WITH {VECS} SELECT label, count(*) AS size FROM vecs WHERE label >= 0 GROUP BY label")
def cluster_sizes(spark, sf_dir):
    return clusters.sizes(vecs(spark, sf_dir))


@query(f"WITH {VECS} SELECT count(DISTINCT CASE WHEN label >= 0 THEN label END) AS n_clusters, count(*) FILTER (label < 0) AS n_noise, count(*) AS n_samples, round(avg((label < 0)::INTEGER), 4) AS noise_ratio FROM vecs")
def cluster_counts(spark, sf_dir):
    return clusters.counts(vecs(spark, sf_dir))


@query(f"WITH {CENTRES} SELECT label, i - 1 AS pos, round(m, 4) + 0 AS m FROM cells")
def cluster_centroids(spark, sf_dir):
    c = clusters.centroids(vecs(spark, sf_dir))
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), (F.round("m", 4) + 0.0).alias("m"))


@query(f"WITH {CENTRES} SELECT label, rank, id, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, id)::INTEGER AS rank FROM members) WHERE rank <= 5")
def cluster_representatives(spark, sf_dir):
    return clusters.representatives(vecs(spark, sf_dir)).select("label", "rank", "id", F.round("distance", 4).alias("distance"))


LOGGED = f"""{VECS}, logged AS (SELECT v.*, CASE e.event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END AS level, 'app-' || (e.user_id % 5) AS source, e.ts FROM vecs v JOIN events e ON e.event_id = v.vec_id)"""


def logged(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("vec_id"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARN").otherwise("INFO").alias("level"),
        F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("source"), "ts",
    )
    return vecs(spark, sf_dir).join(e, "vec_id")


def _mode_sql(value):
    return f"(SELECT label, arg_min({value}, row(-n, first)) AS m FROM (SELECT label, {value}, count(*) AS n, min(vec_id) AS first FROM logged WHERE label >= 0 GROUP BY label, {value}) GROUP BY label)"


@query(f"""WITH {LOGGED} SELECT b.label, b.size, l.m AS common_level, s.m AS common_source, b.time_range_start, b.time_range_end FROM
(SELECT label, count(*) AS size, min(ts) AS time_range_start, max(ts) AS time_range_end FROM logged WHERE label >= 0 GROUP BY label) b JOIN {_mode_sql('level')} l USING (label) JOIN {_mode_sql('source')} s USING (label)""")
def cluster_summary(spark, sf_dir):
    return clusters.summaries(logged(spark, sf_dir)).select("label", "size", "common_level", "common_source", "time_range_start", "time_range_end")


@query(f"WITH {VECS} SELECT label, count(*) AS size FROM vecs WHERE label >= 0 GROUP BY label ORDER BY size DESC, label LIMIT 3")
def top_clusters(spark, sf_dir):
    return clusters.sizes(vecs(spark, sf_dir)).orderBy(F.desc("size"), "label").limit(3)


@query("""WITH x AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x FROM embeddings), r AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT id, least(greatest(floor((x - lo) / ((hi - lo) / 7)), 0), 7)::INTEGER AS label FROM x, r""")
def mock_cluster(spark, sf_dir):
    return clusters.mock_labels(read_table(spark, sf_dir, "embeddings"), 8)


SIL = f"""{VECS}, dist AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, sum(sqrt({d2('a.v', 'b.v')})) AS t, count(*) AS n FROM vecs a, vecs b WHERE a.label >= 0 AND b.label >= 0 GROUP BY ALL),
ab AS (SELECT id, own, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM dist GROUP BY id, own)"""


@query(f"WITH {SIL} SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM ab")
def silhouette(spark, sf_dir):
    return clusters.silhouette(vecs(spark, sf_dir)).select(F.round("silhouette", 4).alias("silhouette"))


DB = f"""{CENTRES}, scatter AS (SELECT label, avg(d) AS s, any_value(c) AS c FROM members GROUP BY label)"""


@query(f"WITH {DB} SELECT round(avg(r), 4) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / sqrt({d2('a.c', 'b.c')})) AS r FROM scatter a JOIN scatter b ON a.label <> b.label GROUP BY a.label)")
def davies_bouldin(spark, sf_dir):
    return clusters.davies_bouldin(vecs(spark, sf_dir)).select(F.round("davies_bouldin", 4).alias("davies_bouldin"))


CH = f"""{CENTRES}, overall AS (SELECT list(m ORDER BY i) AS o FROM (SELECT i, avg(v[i]::DOUBLE) AS m FROM vecs, unnest(range(1, 65)) AS t(i) WHERE label >= 0 GROUP BY i)),
between_ AS (SELECT sum(size * {d2('c.c', 'o.o')}) AS b, count(*) AS k, sum(size) AS n FROM centres c JOIN sizes USING (label), overall o), within_ AS (SELECT sum(d * d) AS w FROM members)"""


@query(f"WITH {CH} SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM between_, within_")
def calinski_harabasz(spark, sf_dir):
    return clusters.calinski_harabasz(vecs(spark, sf_dir)).select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query(f"""WITH {CH}, scatter AS (SELECT label, avg(d) AS s, any_value(c) AS c FROM members GROUP BY label),
dbi AS (SELECT avg(r) AS x FROM (SELECT a.label, max((a.s + b.s) / sqrt({d2('a.c', 'b.c')})) AS r FROM scatter a JOIN scatter b ON a.label <> b.label GROUP BY a.label)), chi AS (SELECT (b / (k - 1)) / (w / (n - k)) AS x FROM between_, within_)
SELECT 'davies_bouldin' AS metric, round(x, 4) AS value, 'lower' AS better, CASE WHEN x <= 0.5 THEN 'Excellent cluster compactness and separation' WHEN x <= 1 THEN 'Good cluster quality' WHEN x <= 2 THEN 'Moderate cluster quality' ELSE 'Poor cluster quality, consider adjusting parameters' END AS meaning FROM dbi
UNION ALL SELECT 'calinski_harabasz', round(x, 4), 'higher', CASE WHEN x >= 500 THEN 'Excellent cluster definition' WHEN x >= 200 THEN 'Good cluster definition' WHEN x >= 50 THEN 'Moderate cluster definition' ELSE 'Weak cluster definition' END FROM chi
UNION ALL SELECT 'noise_share', round(count(*) FILTER (label < 0) / count(*), 4), 'lower', CASE WHEN count(*) FILTER (label < 0) / count(*) <= 0.05 THEN 'little noise' ELSE 'much noise' END FROM vecs""")
def metric_report(spark, sf_dir):
    """Two of the known metrics and one of one's own."""
    share = lambda df, label, _: df.agg(F.avg((F.col(label) < 0).cast("double")).alias("share"))
    clusters.register_metric(clusters.Metric("noise_share", share, False, ((0.05, "little noise"), (None, "much noise"))))
    found = clusters.evaluate(vecs(spark, sf_dir), ["davies_bouldin", "calinski_harabasz", "noise_share"])
    return found.withColumn("value", F.round("value", 4))


@query("""SELECT t.k AS case_no, round(q, 4) AS quality, CASE WHEN q >= 0.8 THEN 'excellent' WHEN q >= 0.6 THEN 'good' WHEN q >= 0.4 THEN 'acceptable' WHEN q >= 0.2 THEN 'poor' ELSE 'very poor' END AS grade FROM (
SELECT k, ((s + 1) / 2 + 1 / (1 + d) + least(1, log10(c + 1) / 3)) / 3 AS q FROM (SELECT vec_id AS k, embedding[1]::DOUBLE AS s, vec_id % 5 / 2.0 AS d, 1.0 + vec_id * 3 AS c FROM embeddings)) t""")
def overall_quality(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_no"), F.col("embedding")[0].cast("double").alias("s"), (F.col("vec_id") % 5 / 2.0).alias("d"), (F.lit(1.0) + F.col("vec_id") * 3).alias("c")
    )
    q = clusters.overall_quality(F.col("s"), F.col("d"), F.col("c"))
    return e.select("case_no", F.round(q, 4).alias("quality"), clusters.grade(q).alias("grade"))


@query("""SELECT vec_id AS case_no, CASE WHEN s >= 0.7 THEN 'Excellent cluster separation' WHEN s >= 0.5 THEN 'Good cluster separation' WHEN s >= 0.25 THEN 'Moderate cluster separation' WHEN s >= 0 THEN 'Weak cluster separation, clusters may overlap' ELSE 'Poor clustering, samples may be misassigned' END AS silhouette_band,
CASE WHEN d <= 0.5 THEN 'Excellent cluster compactness and separation' WHEN d <= 1 THEN 'Good cluster quality' WHEN d <= 2 THEN 'Moderate cluster quality' ELSE 'Poor cluster quality, consider adjusting parameters' END AS db_band,
CASE WHEN c >= 500 THEN 'Excellent cluster definition' WHEN c >= 200 THEN 'Good cluster definition' WHEN c >= 50 THEN 'Moderate cluster definition' ELSE 'Weak cluster definition' END AS ch_band
FROM (SELECT vec_id, embedding[1]::DOUBLE * 4 AS s, vec_id % 7 / 2.0 AS d, 1.0 + vec_id * 3 AS c FROM embeddings)""")
def quality_bands(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_no"), (F.col("embedding")[0].cast("double") * 4).alias("s"), (F.col("vec_id") % 7 / 2.0).alias("d"), (F.lit(1.0) + F.col("vec_id") * 3).alias("c")
    )
    return e.select(
        "case_no", clusters.band(F.col("s"), clusters.SILHOUETTE_BANDS).alias("silhouette_band"),
        clusters.band(F.col("d"), clusters.DAVIES_BOULDIN_BANDS, rising=False).alias("db_band"), clusters.band(F.col("c"), clusters.CALINSKI_HARABASZ_BANDS).alias("ch_band"),
    )


# Evaluation

GOLD = f"{VECS}, gold AS (SELECT vec_id, label AS e, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 12 WHEN vec_id % 31 = 0 THEN -1 ELSE label END AS a FROM vecs)"


def gold(spark, sf_dir):
    a = F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 12).when(F.col("vec_id") % 31 == 0, -1).otherwise(F.col("label"))
    return vecs(spark, sf_dir).select("vec_id", F.col("label").alias("e"), a.cast("int").alias("a"))


ARI = f"""{GOLD}, cells AS (SELECT e, a, count(*)::DOUBLE AS n FROM gold WHERE e >= 0 AND a >= 0 GROUP BY e, a), te AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM cells GROUP BY e)),
ta AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM cells GROUP BY a)), tc AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS h, sum(CASE WHEN e = a THEN n ELSE 0 END) AS hit FROM cells),
q AS (SELECT tc.n, tc.p AS tp, ta.p - tc.p AS fp, te.p - tc.p AS fn, tc.n * (tc.n - 1) / 2 - ta.p - te.p + tc.p AS tn, ln(tc.n) - te.h / tc.n AS he, ln(tc.n) - ta.h / tc.n AS ha, ln(tc.n) - tc.h / tc.n AS hc, hit FROM tc, te, ta),
scores AS (SELECT n::BIGINT AS n, 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) AS ari, (he + ha - hc) / ((he + ha) / 2) AS nmi, hit / n AS accuracy FROM q)"""


@query(f"WITH {ARI} SELECT n, round(ari, 4) AS ari, round(nmi, 4) AS nmi, round(accuracy, 4) AS accuracy FROM scores")
def ari_nmi(spark, sf_dir):
    return evaluation.contingency_scores(gold(spark, sf_dir), "e", "a").select("n", *[F.round(c, 4).alias(c) for c in ("ari", "nmi", "accuracy")])


@query(f"WITH {ARI} SELECT CASE WHEN ari < 0.6 THEN 'FAILED' WHEN ari < 0.7 THEN 'DEGRADED' WHEN ari > 0.8 THEN 'IMPROVED' ELSE 'PASSED' END AS status FROM scores")
def regression_status(spark, sf_dir):
    return evaluation.contingency_scores(gold(spark, sf_dir), "e", "a").select(evaluation.regression_status(F.col("ari")).alias("status"))


@query(f"WITH {GOLD} SELECT vec_id, e, a FROM gold WHERE e >= 0 AND e <> a")
def misclassified(spark, sf_dir):
    return gold(spark, sf_dir).where("e >= 0 and e <> a")


@query(f"WITH {GOLD} (SELECT a AS label, 'new' AS change FROM gold WHERE a >= 0 EXCEPT SELECT e, 'new' FROM gold) UNION ALL (SELECT e, 'missing' FROM gold WHERE e >= 0 EXCEPT SELECT a, 'missing' FROM gold)")
def cluster_set_changes(spark, sf_dir):
    g = gold(spark, sf_dir)
    return evaluation.set_changes(g.where("e >= 0").select(F.col("e").alias("label")), g.where("a >= 0").select(F.col("a").alias("label")), "label")


KAPPA = """c AS (SELECT count(*)::DOUBLE AS n, avg((quality = toxic)::INTEGER) AS po FROM labels), p AS (SELECT sum(x.n * y.n) AS chance FROM (SELECT quality AS l, count(*)::DOUBLE AS n FROM labels GROUP BY 1) x JOIN (SELECT toxic AS l, count(*)::DOUBLE AS n FROM labels GROUP BY 1) y USING (l)),
k AS (SELECT n::BIGINT AS n, po, chance / (n * n) AS pe FROM c, p)"""


@query(f"WITH {KAPPA} SELECT n, round(po, 4) AS agreement, round(pe, 4) AS expected, round((po - pe) / (1 - pe), 4) AS kappa FROM k")
def cohens_kappa(spark, sf_dir):
    k = evaluation.cohens_kappa(read_table(spark, sf_dir, "labels"), "quality", "toxic")
    return k.select("n", *[F.round(c, 4).alias(c) for c in ("agreement", "expected", "kappa")])


@query("SELECT round(avg((quality = toxic)::INTEGER), 4) AS agreement_rate FROM labels")
def agreement_rate(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 4).alias("agreement_rate"))


@query("""WITH t AS (SELECT CASE user_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'different' WHEN 2 THEN 'unsure' ELSE 'same' END AS label FROM events)
SELECT n.label, count(t.label) AS n FROM (VALUES ('same'), ('different'), ('similar'), ('unsure'), ('skip')) AS n(label) LEFT JOIN t USING (label) GROUP BY n.label""")
def label_distribution(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").selectExpr("CASE user_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'different' WHEN 2 THEN 'unsure' ELSE 'same' END AS label")
    return evaluation.label_distribution(e, "label")


@query(f"WITH {VECS}, c AS (SELECT DISTINCT label FROM vecs WHERE label >= 0) SELECT a.label || '-' || b.label AS pair_id, a.label AS a, b.label AS b FROM c a JOIN c b ON a.label < b.label")
def cluster_pairs(spark, sf_dir):
    c = clusters.live(vecs(spark, sf_dir)).select("label").distinct()
    return evaluation.cluster_pairs(c, "label")


@query("""WITH a AS (SELECT doc_id AS pair_id, quality AS la FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS pair_id, toxic AS lb FROM labels WHERE doc_id % 2 = 0)
SELECT pair_id, la, lb, la = lb AS agree FROM a JOIN b USING (pair_id)""")
def common_pairs(spark, sf_dir):
    x = read_table(spark, sf_dir, "labels")
    a = x.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("la"))
    b = x.where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair_id"), F.col("toxic").alias("lb"))
    return a.join(b, "pair_id").withColumn("agree", F.col("la") == F.col("lb"))


RUNS = "runs AS (SELECT event_type AS config, value / 500 AS quality FROM events)"


def runs(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), (F.col("value") / 500).alias("quality"))


@query(f"WITH {RUNS}, m AS (SELECT config, count(*) AS n_runs, avg(quality) AS q FROM runs GROUP BY config) SELECT config, n_runs, round(q, 4) AS mean_quality, q = (SELECT max(q) FROM m) AS is_best FROM m")
def ablation_best(spark, sf_dir):
    s = evaluation.ablation_summary(runs(spark, sf_dir))
    return s.select("config", "n_runs", F.round("mean_quality", 4).alias("mean_quality"), "is_best")


@query(f"""WITH {RUNS}, m AS (SELECT config, avg(quality) AS q, var_samp(quality) AS v, count(*) AS n FROM runs GROUP BY config)
SELECT a.config AS a, b.config AS b, round(a.q - b.q, 6) AS difference, CASE WHEN a.q > b.q THEN a.config ELSE b.config END AS winner,
round((a.q - b.q) / sqrt((((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 4) AS t FROM m a JOIN m b ON a.config < b.config""")
def ablation_compare(spark, sf_dir):
    c = evaluation.ablation_compare(runs(spark, sf_dir))
    return c.select("a", "b", F.round("difference", 6).alias("difference"), "winner", F.round("t", 4).alias("t"))


@query()
def ablation_significance(spark, sf_dir):
    return evaluation.ablation_compare(runs(spark, sf_dir)).select("a", "b", F.round("p_value", 6).alias("p_value"))


HIST = "hist AS (SELECT event_type AS metric, event_id AS ts, value, event_type <> 'error' AS up FROM events), l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY ts) AS previous FROM hist)"


@query(f"""WITH {HIST}, c AS (SELECT *, CASE WHEN previous = 0 THEN 0 ELSE (value - previous) / abs(previous) END AS change FROM l)
SELECT metric, ts, round(change, 4) AS change, CASE WHEN previous IS NULL THEN 'unknown' WHEN abs(change) < 0.05 THEN 'stable' WHEN (change > 0) = up THEN 'improving' ELSE 'degrading' END AS direction FROM c""")
def metric_trend(spark, sf_dir):
    h = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("ts"), "value", (F.col("event_type") != "error").alias("higher_is_better"))
    return evaluation.trends(h).select("metric", "ts", F.round("change", 4).alias("change"), "direction")


@query(f"WITH {HIST} SELECT metric, ts, value FROM hist QUALIFY row_number() OVER (PARTITION BY metric ORDER BY ts DESC) <= 5")
def metric_history(spark, sf_dir):
    h = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("ts"), "value")
    return evaluation.latest(h, 5)


@query("""WITH s AS (SELECT event_type AS name, value AS x FROM events), r AS (SELECT name, x, row_number() OVER (PARTITION BY name ORDER BY x) AS r, count(*) OVER (PARTITION BY name) AS n FROM s)
SELECT name, count(*) AS n, round(sum(x), 2) AS total, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(coalesce(stddev_samp(x), 0), 4) AS stdev, min(x) AS least, max(x) AS most,
max(CASE WHEN r = least(floor(n * 0.95), n - 1) + 1 THEN x END) AS p95, max(CASE WHEN r = least(floor(n * 0.99), n - 1) + 1 THEN x END) AS p99 FROM r GROUP BY name""")
def timing_stats(spark, sf_dir):
    s = evaluation.timing_stats(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("sample")))
    return s.select("name", "n", F.round("total", 2).alias("total"), *[F.round(c, 4).alias(c) for c in ("mean", "median", "stdev")], "least", "most", "p95", "p99")


@query("""SELECT user_id, round(CASE WHEN d > 0 THEN items / d ELSE 0 END, 4) AS items_per_second, round(CASE WHEN d > 0 THEN bytes / d / 1048576 ELSE 0 END, 6) AS mb_per_second
FROM (SELECT user_id, count(*) AS items, sum(event_id) AS bytes, CASE WHEN user_id % 10 = 0 THEN 0 ELSE sum(value) END AS d FROM events GROUP BY user_id)""")
def throughput(spark, sf_dir):
    g = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("items"), F.sum("event_id").alias("bytes"), F.sum("value").alias("d"))
    t = evaluation.throughput(F.col("items"), F.col("bytes"), F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("d")))
    return g.select("user_id", F.round(t["items_per_second"], 4).alias("items_per_second"), F.round(t["mb_per_second"], 6).alias("mb_per_second"))
