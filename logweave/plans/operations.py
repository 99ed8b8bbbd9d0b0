"""Alert routing, retention, versions, profiles, display texts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..operators import explain, retention, routing, versions
from ..operators.routing import Rule
from ..session import read_table
from .registry import query

EVENTS_SQL = """alerts AS (SELECT event_id AS id, value / 500 AS score, 'app-' || (user_id % 5) AS source, CASE WHEN event_type = 'error' THEN 'security' ELSE event_type END AS tag, user_id,
 CASE WHEN value / 500 >= 0.9 THEN 'critical' WHEN value / 500 >= 0.7 THEN 'high' WHEN value / 500 >= 0.5 THEN 'medium' WHEN value / 500 >= 0.3 THEN 'low' ELSE 'info' END AS priority FROM events)"""


def alerts(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    score = F.col("value") / 500
    return e.select(
        F.col("event_id").alias("id"), score.alias("score"), F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.array(F.when(F.col("event_type") == "error", "security").otherwise(F.col("event_type"))).alias("tags"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")).alias("metadata"), routing.priority(score).alias("priority"),
    )


@query(f"WITH {EVENTS_SQL} SELECT priority, count(*) AS n FROM alerts GROUP BY priority")
def alert_priority(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("n"))


RULES = [
    Rule("urgent", ["pager", "slack"], least_priority="high"),
    Rule("security", ["slack", "email"], tags=["security"]),
    Rule("app one", ["email"], source_pattern="^app-1$", metadata={"user_id": ("gte", 20)}),
    Rule("off", ["webhook"], enabled=False),
]
HITS = """hits AS (SELECT *, priority IN ('high', 'critical') AS r0, tag = 'security' AS r1, source = 'app-1' AND user_id >= 20 AS r2 FROM alerts)"""


@query(f"""WITH {EVENTS_SQL}, {HITS} SELECT id, array_to_string(list_filter([CASE WHEN r0 THEN 'urgent' END, CASE WHEN r1 THEN 'security' END, CASE WHEN r2 THEN 'app one' END], lambda x: x IS NOT NULL), ',') AS matched,
CASE WHEN NOT (r0 OR r1 OR r2) THEN 'log' ELSE array_to_string(list_filter([CASE WHEN r0 THEN 'pager' END, CASE WHEN r0 OR r1 THEN 'slack' END, CASE WHEN r1 OR r2 THEN 'email' END], lambda x: x IS NOT NULL), ',') END AS targets FROM hits""")
def route_alerts(spark, sf_dir):
    r = routing.route(alerts(spark, sf_dir), RULES, ["log"])
    return r.select("id", F.array_join("matched", ",").alias("matched"), F.array_join("targets", ",").alias("targets"))


@query(f"""WITH {EVENTS_SQL}, {HITS} SELECT id, array_to_string(list_filter([CASE WHEN r1 THEN 'security' END, CASE WHEN r0 AND NOT r1 THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS matched FROM hits""")
def route_stop_on_match(spark, sf_dir):
    rules = [Rule("security", ["slack"], tags=["security"], stop=True), RULES[0]]
    return routing.route(alerts(spark, sf_dir), rules).select("id", F.array_join("matched", ",").alias("matched"))


@query(f"""WITH {EVENTS_SQL} SELECT count(*) AS events, count(*) FILTER (tag = 'security' OR score >= 0.7) AS routed, count(*) FILTER (NOT (tag = 'security' OR score >= 0.7)) AS unrouted FROM alerts""")
def router_stats(spark, sf_dir):
    r = routing.route(alerts(spark, sf_dir), RULES[:2])
    return r.agg(F.count("*").alias("events"), F.count_if(F.size("matched") > 0).alias("routed"), F.count_if(F.size("matched") == 0).alias("unrouted"))


OPS = {"eq": ("equals", "7"), "has": ("contains", "7"), "rx": ("regex", "^1[0-9]$"), "in_": ("in", [3, 5]), "out": ("not_in", [3, 5]), "ge": ("gte", 100), "le": ("lte", 9)}


@query("""SELECT event_id AS id, user_id = 7 AS eq, contains(user_id::VARCHAR, '7') AS has, user_id BETWEEN 10 AND 19 AS rx, user_id IN (3, 5) AS in_, user_id NOT IN (3, 5) AS out, user_id >= 100 AS ge, user_id <= 9 AS le FROM events""")
def match_operators(spark, sf_dir):
    return alerts(spark, sf_dir).select("id", *[routing.match_value(F.col("metadata")["user_id"], op).alias(k) for k, op in OPS.items()])


@query(f"""WITH {EVENTS_SQL} SELECT id, '{{"text":"[' || upper(priority) || '] event ' || id || '","blocks":[{{"type":"section","text":{{"type":"mrkdwn","text":"from ' || source || '"}}}}]}}' AS slack, '{{"subject":"[' || upper(priority) || '] event ' || id || '","body":"from ' || source || '"}}' AS email,
'event ' || id || ' is ' || priority || ' in $place' AS note FROM alerts""")
def notifier_payloads(spark, sf_dir):
    a = alerts(spark, sf_dir).withColumns({"event_id": F.col("id").cast("string"), "title": F.concat(F.lit("event "), F.col("id").cast("string")), "message": F.concat(F.lit("from "), F.col("source"))})
    return a.select("id", routing.payload("slack").alias("slack"), routing.payload("email").alias("email"), routing.template("$title is $priority in $place", ["title", "priority", "source"]).alias("note"))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT id, 'app ' || source || ' ' || priority AS title FROM alerts) SELECT title, min(id) AS id FROM t WHERE title NOT LIKE '%info' GROUP BY title""")
def issue_dedup(spark, sf_dir):
    a = alerts(spark, sf_dir).select(F.col("id"), F.col("id").alias("event_id"), F.concat_ws(" ", F.lit("app"), "source", "priority").alias("title"))
    open_issues = a.where("title like '%info'").select("title")
    return routing.new_issues(a, open_issues).select("title", "id")


@query("""WITH c AS (SELECT user_id % 20 AS host, CASE WHEN user_id % 50 = 0 THEN 'unhealthy' WHEN event_type = 'error' AND value > 150 THEN 'degraded' ELSE 'healthy' END AS status FROM events)
SELECT host, CASE max(CASE status WHEN 'unhealthy' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM c GROUP BY host""")
def health_rollup(spark, sf_dir):
    c = read_table(spark, sf_dir, "events").selectExpr("user_id % 20 AS host", "CASE WHEN user_id % 50 = 0 THEN 'unhealthy' WHEN event_type = 'error' AND value > 150 THEN 'degraded' ELSE 'healthy' END AS status")
    return routing.health(c, ["host"])


@query("""WITH n AS (SELECT user_id % 30 AS host, user_id % 30 > 3 AND (user_id % 30 > 20 OR event_type <> 'error') AS ok FROM events)
SELECT host, CASE WHEN count(*) FILTER (ok) = count(*) THEN 'healthy' WHEN count(*) FILTER (ok) = 0 THEN 'unhealthy' ELSE 'degraded' END AS status, count(*) AS total, count(*) FILTER (ok) AS working FROM n GROUP BY host""")
def notifier_health(spark, sf_dir):
    n = read_table(spark, sf_dir, "events").selectExpr("user_id % 30 AS host", "user_id % 30 > 3 AND (user_id % 30 > 20 OR event_type <> 'error') AS healthy")
    return routing.notifier_health(n, ["host"])


FILES_SQL = """files AS (SELECT source AS dir, source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.jsonl' ELSE '.log' END AS path, ((SELECT max(doc_id) FROM documents) - doc_id)::DOUBLE / 10 AS age_days, n_chars AS size_bytes FROM documents)"""


def files(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    newest = d.agg(F.max("doc_id")).first()[0]
    return d.select(
        F.col("source").alias("dir"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".jsonl").otherwise(".log")).alias("path"),
        ((F.lit(newest) - F.col("doc_id")).cast("double") / 10).alias("age_days"), F.col("n_chars").alias("size_bytes"),
    )


RETAIN = f"""{FILES_SQL}, w AS (SELECT *, sum(size_bytes) OVER (PARTITION BY dir) - coalesce(sum(size_bytes) OVER (PARTITION BY dir ORDER BY age_days DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM files),
d AS (SELECT *, array_to_string(list_filter([CASE WHEN age_days > 80 THEN 'age' END, CASE WHEN rest > 60000 THEN 'size' END], lambda x: x IS NOT NULL), ',') AS reasons FROM w)"""


@query(f"WITH {RETAIN} SELECT dir, count(*) AS deleted, sum(size_bytes)::BIGINT AS freed FROM d WHERE reasons <> '' GROUP BY dir")
def retention_apply(spark, sf_dir):
    d = retention.decisions(files(spark, sf_dir), 80, 60000, by="dir").where("delete")
    return d.groupBy("dir").agg(F.count("*").alias("deleted"), F.sum("size_bytes").alias("freed"))


@query(f"WITH {RETAIN} SELECT path, reasons FROM d WHERE reasons <> ''")
def retention_preview(spark, sf_dir):
    return retention.decisions(files(spark, sf_dir), 80, 60000, by="dir").where("delete").select("path", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {FILES_SQL} SELECT path, age_days > 50 AND size_bytes > 2000 AS both, age_days > 50 OR size_bytes > 20000 AS either FROM files WHERE path LIKE '%.log' AND path NOT LIKE 'src1/%'")
def retention_criteria(spark, sf_dir):
    f = files(spark, sf_dir).where(retention.included(F.col("path"), ["*.log"], ["src1/*"]))
    age, size = retention.over_age(F.col("age_days"), 50), F.col("size_bytes")
    return f.select("path", retention.all_of(age, retention.over_size(size, 2000)).alias("both"), retention.any_of(age, retention.over_size(size, 20000)).alias("either"))


@query(f"WITH {FILES_SQL} SELECT dir, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_bytes, max(age_days) AS oldest_days, min(age_days) AS newest_days FROM files GROUP BY dir")
def directory_stats(spark, sf_dir):
    return retention.directory_stats(files(spark, sf_dir), by="dir")


@query("""SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5 AS keep FROM orders""")
def snapshot_keep_n(spark, sf_dir):
    s = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), "o_custkey")
    return retention.keep_newest(s, 5, by="o_custkey").select("id", "keep")


@query("""SELECT o_custkey AS store, count(*) AS snapshots, count(*) FILTER (o_orderstatus = 'F') AS valid, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey""")
def snapshot_stats(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("store")).agg(
        F.count("*").alias("snapshots"), F.count_if(F.col("o_orderstatus") == "F").alias("valid"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest")
    )


@query("""SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'checksum mismatch' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def bundle_verify(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("checksum"))
    found = d.where("doc_id % 7 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 11 == 0, F.sha2("checksum", 256)).otherwise(F.col("checksum")))
    return retention.verify_manifest(d, found)


EDGES = [("1.0", "1.1", "m1"), ("1.1", "1.2", "m2"), ("1.2", "2.0", "m3"), ("1.0", "2.0", "m9"), ("2.0", "2.1", "m4"), ("1.1", "1.0", "m0")]


@query("""WITH RECURSIVE edges(f, t, m) AS (VALUES ('1.0','1.1','m1'),('1.1','1.2','m2'),('1.2','2.0','m3'),('1.0','2.0','m9'),('2.0','2.1','m4'),('1.1','1.0','m0')),
walk(v, path, hops) AS (SELECT '1.0', '', 0 UNION ALL SELECT t, CASE WHEN path = '' THEN m ELSE path || ',' || m END, hops + 1 FROM walk JOIN edges ON v = f WHERE hops < 6)
SELECT hops, path FROM walk WHERE v = '2.1' ORDER BY hops, path LIMIT 1""")
def migration_path(spark, sf_dir):
    e = spark.createDataFrame(EDGES, "from_version string, to_version string, migration_id string")
    return versions.migration_path(e, "1.0", "2.1").select("hops", F.array_join("path", ",").alias("path"))


@query("""SELECT user_id % 4 || '.' || event_id % 9 AS version, user_id % 4 > 1 OR (user_id % 4 = 1 AND event_id % 9 > 4) AS newer_than_1_4 FROM events""")
def version_compare(spark, sf_dir):
    v = read_table(spark, sf_dir, "events").selectExpr("user_id % 4 AS a", "event_id % 9 AS b")
    said = F.concat_ws(".", F.col("a").cast("string"), F.col("b").cast("string"))
    key = versions.sort_key(versions.parse(F.concat(said, F.lit(".0"))))
    return v.select(said.alias("version"), (key > versions.sort_key(versions.parse(F.lit("1.4.0")))).alias("newer_than_1_4"))


SPANS_SQL = "spans AS (SELECT user_id AS id, CASE WHEN user_id = 0 THEN NULL ELSE user_id // 3 END AS parent, sum(value) AS ms FROM events GROUP BY user_id)"


@query(f"""WITH RECURSIVE {SPANS_SQL}, tree(id, depth, path) AS (SELECT id, 0, id::VARCHAR FROM spans WHERE parent IS NULL UNION ALL SELECT s.id, depth + 1, path || '/' || s.id FROM tree JOIN spans s ON s.parent = tree.id)
SELECT id, depth, path FROM tree""")
def profile_tree(spark, sf_dir):
    spans = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("ms"))
    spans = spans.withColumn("parent", F.when(F.col("id") > 0, F.floor(F.col("id") / 3)))
    return spark.sql("""WITH RECURSIVE tree(id, depth, path) AS (SELECT id, 0, CAST(id AS STRING) FROM {spans} WHERE parent IS NULL
        UNION ALL SELECT s.id, depth + 1, concat(path, '/', s.id) FROM tree JOIN {spans} s ON s.parent = tree.id) SELECT id, depth, path FROM tree""", spans=spans)


@query("SELECT event_type AS name, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS percent FROM events GROUP BY event_type")
def profile_shares(spark, sf_dir):
    from pyspark.sql import Window

    by = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("ms"))
    return by.select("name", F.round(100 * F.col("ms") / F.sum("ms").over(Window.partitionBy(F.lit(0))), 4).alias("percent"))


@query("""SELECT user_id % 9 AS batch, max(value) AS peak, round(max_by(value, event_id) - min_by(value, event_id), 4) AS growth FROM events GROUP BY user_id % 9""")
def memory_growth(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy((F.col("user_id") % 9).alias("batch")).agg(
        F.max("value").alias("peak"), F.round(F.max_by("value", "event_id") - F.min_by("value", "event_id"), 4).alias("growth")
    )


@query("""WITH t AS (SELECT event_id AS id, text, row_number() OVER (PARTITION BY text ORDER BY event_id) > 1 AS hit FROM (SELECT event_id, event_type || user_id AS text FROM events))
SELECT count(*) AS lookups, count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER), 4) AS hit_rate FROM t""")
def cache_hit_rate(spark, sf_dir):
    t = read_table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("text"))
    by = t.groupBy("text").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("lookups"), F.sum(F.col("n") - 1).alias("hits"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 4).alias("hit_rate"))


@query("""SELECT user_id, count(*) AS requests, round(avg((event_type <> 'error')::INTEGER), 4) AS success_rate, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_latency, (sum(event_id % 10) FILTER (event_type <> 'error'))::BIGINT AS tokens FROM events GROUP BY user_id""")
def request_stats(spark, sf_dir):
    ok = F.col("event_type") != "error"
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("requests"), F.round(F.avg(ok.cast("int")), 4).alias("success_rate"), F.round(F.avg(F.when(ok, F.col("value"))), 4).alias("mean_latency"),
        F.sum(F.when(ok, F.col("event_id") % 10)).alias("tokens"),
    )


@query("""SELECT event_id AS id, CASE WHEN s < 1 THEN format('{:.0f}ms', s * 1000) WHEN s < 60 THEN format('{:.1f}s', s) WHEN s < 3600 THEN format('{}m {:.0f}s', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) ELSE format('{}h {}m', floor(s / 3600)::BIGINT, floor((s - floor(s / 3600) * 3600) / 60)::BIGINT) END AS duration
FROM (SELECT event_id, (event_id % 977) * (event_id % 13) + 0.25::DOUBLE AS s FROM events)""")
def format_durations(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), display.duration((F.col("event_id") % 977) * (F.col("event_id") % 13) + F.lit(0.25)).alias("duration"))


@query("""SELECT event_id AS id, CASE WHEN r >= 1000000 THEN format('{:.1f}M logs/s', r / 1000000) WHEN r >= 1000 THEN format('{:.1f}K logs/s', r / 1000) WHEN r >= 1 THEN format('{:.1f} logs/s', r) ELSE format('{:.1f} logs/min', r * 60) END AS rate,
'[' || repeat('█', floor(s * 20)::INTEGER) || repeat('░', 20 - floor(s * 20)::INTEGER) || ']' AS bar, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.5 THEN 'medium' WHEN s >= 0.3 THEN 'low' ELSE 'info' END AS colour
FROM (SELECT event_id, pow(event_id % 101, 4) / 16 AS r, value / 500 AS s FROM events)""")
def format_rates(spark, sf_dir):
    r, s = F.pow((F.col("event_id") % 101).cast("double"), F.lit(4.0)) / 16, F.col("value") / 500
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), display.rate(r, "logs").alias("rate"), display.score_bar(s).alias("bar"), display.novelty_colour(s).alias("colour"))


def _sql_prompt(prompt: str, **holes: str) -> str:
    import re

    parts = re.split(r"<(\w+)>", prompt)
    return " || ".join("'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"coalesce(({holes[p]})::VARCHAR, 'unknown')" for i, p in enumerate(parts))


@query("SELECT event_id AS id, " + _sql_prompt(explain.NOVELTY_PROMPT, log_message="event_type || ' by ' || user_id", novelty_score="format('{:.2f}', value / 500)", threshold="'0.7'", n_reference="100") + " AS prompt FROM events")
def novelty_prompts(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    p = explain.fill(explain.NOVELTY_PROMPT, log_message=F.concat_ws(" by ", "event_type", F.col("user_id").cast("string")), novelty_score=display.fixed(F.col("value") / 500, 2), threshold=F.lit("0.7"), n_reference=F.lit(100))
    return e.select(F.col("event_id").alias("id"), p.alias("prompt"))


@query("SELECT event_id AS id, " + _sql_prompt(explain.ERROR_PROMPT, error_message="event_type", log_level="CASE WHEN event_id % 40 = 0 THEN 'ERROR' END", source="'app'", timestamp="strftime(ts, '%Y-%m-%d')", context="props") + " AS prompt FROM events")
def error_prompts(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    p = explain.fill(explain.ERROR_PROMPT, error_message=F.col("event_type"), log_level=F.when(F.col("event_id") % 40 == 0, "ERROR"), source=F.lit("app"), timestamp=F.date_format("ts", "yyyy-MM-dd"), context=F.col("props"))
    return e.select(F.col("event_id").alias("id"), p.alias("prompt"))


@query("WITH c AS (SELECT user_id, count(*) AS n, list(event_type || ' ' || event_id ORDER BY event_id)[1:10] AS m FROM events GROUP BY user_id) SELECT user_id, " + _sql_prompt(explain.CLUSTER_PROMPT, n_logs="n", log_messages="array_to_string(list_transform(m, lambda x: '- ' || x), chr(10))", cluster_size="n", common_level="'INFO'", time_range="NULL") + " AS prompt FROM c")
def cluster_prompts(spark, sf_dir):
    said = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    w = read_table(spark, sf_dir, "events")
    from pyspark.sql import Window

    ranked = w.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    c = ranked.groupBy("user_id").agg(
        F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 10, F.struct("r", said.alias("m"))))), lambda s: s["m"]).alias("m")
    )
    p = explain.fill(explain.CLUSTER_PROMPT, n_logs=F.col("n"), log_messages=explain.bullets(F.col("m")), cluster_size=F.col("n"), common_level=F.lit("INFO"), time_range=F.lit(None))
    return c.select("user_id", p.alias("prompt"))


@query("SELECT 1 AS id, " + _sql_prompt(explain.SUMMARY_PROMPT, total_logs="(SELECT count(*) FROM events)", n_clusters="3", n_novel="2", cluster_summaries="'- a' || chr(10) || '- b'", novelty_summaries="'- c'") + " AS prompt")
def summary_prompt(spark, sf_dir):
    n = read_table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    p = explain.fill(explain.SUMMARY_PROMPT, total_logs=F.col("n"), n_clusters=F.lit(3), n_novel=F.lit(2), cluster_summaries=explain.bullets(F.array(F.lit("a"), F.lit("b")), 5), novelty_summaries=explain.bullets(F.array(F.lit("c")), 5))
    return n.select(F.lit(1).alias("id"), p.alias("prompt"))


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'high' WHEN event_id % 3 = 0 THEN 'medium' WHEN event_id % 3 = 1 THEN 'low' ELSE 'medium' END AS severity, 0.85::DOUBLE AS confidence, 3 AS actions FROM events""")
def mock_answers(spark, sf_dir):
    prompt = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 3 == 0, "a WARNING").when(F.col("event_id") % 3 == 1, "info only").otherwise("x"))
    a = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), explain.parse_answer(explain.mock_answer(prompt)["text"]).alias("a"))
    return a.select("id", "a.severity", "a.confidence", F.size("a.suggested_actions").alias("actions"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'info' WHEN 2 THEN 'info' END AS severity, CASE event_id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 END::DOUBLE AS confidence, CASE WHEN event_id % 4 < 3 THEN event_type END AS summary FROM events""")
def parse_answers(spark, sf_dir):
    k, t = F.col("event_id") % 4, F.col("event_type")
    text = (
        F.when(k == 0, F.concat(F.lit('```json\n{"summary": "'), t, F.lit('", "severity": "LOW",\n"confidence": 0.25}\n```')))
        .when(k == 1, F.concat(F.lit('Sure: {"summary": "'), t, F.lit('", "severity": "terrible"}'))).when(k == 2, F.concat(F.lit('{"summary": "'), t, F.lit('"}')))
        .otherwise(F.lit('{"summary": broken}'))
    )
    a = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), explain.parse_answer(text).alias("a"))
    return a.select("id", "a.severity", "a.confidence", "a.summary")
