"""Parsing queries over printed log lines, and the stages around parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import changelog, preprocess, versions
from ..session import read_table
from .lines import LINES_SQL, log_lines
from .registry import query

#: The answer for each printed line follows from how it was printed.
KNOWN = (
    LINES_SQL
    + """, known AS (
  SELECT l.*, e.ts AS moment, round(e.value * 100)::BIGINT::VARCHAR AS c, l.id % 8 AS f, l.event_type = 'error' AS loud
  FROM log_lines l JOIN events e ON e.event_id = l.id
), parsed AS (
  SELECT id, line, source, event_type, user_id, c, f, loud,
    CASE f WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'nginx' WHEN 3 THEN 'nginx' WHEN 4 THEN 'python_traceback' ELSE 'common' END AS parser,
    CASE f WHEN 0 THEN event_type || ' by user ' || user_id WHEN 1 THEN regexp_extract(line, ']: (.*)$', 1)
      WHEN 2 THEN regexp_extract(line, '"(GET [^"]+)" ([0-9]+)', 1) || ' ' || regexp_extract(line, '"(GET [^"]+)" ([0-9]+)', 2)
      WHEN 3 THEN 'upstream ' || event_type || ' timed out' WHEN 4 THEN line
      WHEN 5 THEN regexp_extract(line, '(?:ERROR|WARNING) (.*)$', 1) WHEN 6 THEN regexp_extract(line, '^[^ ]+ (.*)$', 1) ELSE regexp_replace(line, '^error ', '') END AS message,
    CASE f WHEN 0 THEN CASE WHEN loud THEN 'ERROR' ELSE 'INFO' END WHEN 1 THEN CASE WHEN loud THEN 'ERROR' END
      WHEN 2 THEN CASE WHEN loud THEN 'ERROR' WHEN event_type = 'view' THEN 'WARN' ELSE 'INFO' END
      WHEN 3 THEN CASE WHEN loud THEN 'ERROR' ELSE 'NOTICE' END WHEN 4 THEN 'ERROR'
      WHEN 5 THEN CASE WHEN loud THEN 'ERROR' ELSE 'WARN' END WHEN 6 THEN CASE WHEN loud THEN 'FATAL' ELSE 'DEBUG' END
      ELSE CASE WHEN loud THEN 'ERROR' END END AS level,
    CASE WHEN f IN (0, 1, 2, 3, 5) THEN strftime(date_trunc('second', moment), '%Y-%m-%d %H:%M:%S') END AS ts
  FROM known
)"""
)


def _parsed(spark, sf_dir):
    df = parsing.parse_lines(log_lines(spark, sf_dir), "line", parsing.ParserRegistry(year=2024))
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {KNOWN} SELECT id, parser, message, level, ts FROM parsed")
def parse_registry(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "parser", "message", "level", "ts")


@query(f"WITH {KNOWN} SELECT id, message, level, ts FROM parsed WHERE parser = 'json'")
def parse_json(spark, sf_dir):
    return _parsed(spark, sf_dir).where("parser = 'json'").select("id", "message", "level", "ts")


@query(f"WITH {KNOWN} SELECT id, message, level, ts, 'host' || user_id AS hostname, 'app' AS program, c AS pid FROM parsed WHERE parser = 'syslog'")
def parse_syslog(spark, sf_dir):
    return _parsed(spark, sf_dir).where("parser = 'syslog'").select(
        "id", "message", "level", "ts", *[F.col("attrs")[k].alias(k) for k in ("hostname", "program", "pid")]
    )


@query(f"WITH {KNOWN} SELECT id, message, level, ts, '10.0.1.' || user_id AS ip, CASE WHEN loud THEN '500' WHEN event_type = 'view' THEN '404' ELSE '200' END AS status, c AS bytes, 'curl/7.68.0' AS user_agent FROM parsed WHERE f = 2")
def parse_nginx_access(spark, sf_dir):
    df = _parsed(spark, sf_dir).where("parser = 'nginx' and attrs['status'] is not null")
    return df.select("id", "message", "level", "ts", *[F.col("attrs")[k].alias(k) for k in ("ip", "status", "bytes", "user_agent")])


@query(f"WITH {KNOWN} SELECT id, message, level, ts, user_id::VARCHAR AS pid, c AS tid FROM parsed WHERE f = 3")
def parse_nginx_error(spark, sf_dir):
    df = _parsed(spark, sf_dir).where("parser = 'nginx' and attrs['tid'] is not null")
    return df.select("id", "message", "level", "ts", F.col("attrs")["pid"].alias("pid"), F.col("attrs")["tid"].alias("tid"))


@query(f"WITH {KNOWN} SELECT id, level, CASE WHEN loud THEN 'ValueError' END AS exception_type, CASE WHEN loud THEN 'bad value ' || c END AS exception_message FROM parsed WHERE f = 4")
def parse_traceback(spark, sf_dir):
    return _parsed(spark, sf_dir).where("parser = 'python_traceback'").select(
        "id", "level", F.col("attrs")["exception_type"].alias("exception_type"), F.col("attrs")["exception_message"].alias("exception_message")
    )


@query(f"WITH {KNOWN} SELECT id, message, level, ts FROM parsed WHERE parser = 'common'")
def parse_common(spark, sf_dir):
    return _parsed(spark, sf_dir).where("parser = 'common'").select("id", "message", "level", "ts")


@query(f"""WITH {LINES_SQL} SELECT id, CASE WHEN up LIKE '%ERROR%' OR up LIKE '%FAIL%' THEN 'ERROR' WHEN up LIKE '%WARN%' THEN 'WARN' WHEN up LIKE '%DEBUG%' THEN 'DEBUG'
WHEN up LIKE '%INFO%' THEN 'INFO' WHEN up LIKE '%FATAL%' OR up LIKE '%CRITICAL%' THEN 'FATAL' END AS level FROM (SELECT id, upper(line) AS up FROM log_lines)""")
def infer_level(spark, sf_dir):
    return log_lines(spark, sf_dir).select("id", parsing.infer_level(F.col("line")).alias("level"))


@query("""SELECT s AS status, CASE substr(s, 1, 1) WHEN '4' THEN 'WARN' WHEN '5' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n
FROM (SELECT (100 + event_id % 500)::VARCHAR AS s FROM events) GROUP BY s""")
def status_levels(spark, sf_dir):
    status = read_table(spark, sf_dir, "events").select((100 + F.col("event_id") % 500).cast("string").alias("status"))
    return status.groupBy("status", parsing.status_level(F.col("status")).alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT l AS raw_level, CASE upper(l) WHEN 'WARNING' THEN 'WARN' WHEN 'CRITICAL' THEN 'FATAL' ELSE upper(l) END AS level, count(*) AS n
FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'Critical' WHEN 2 THEN 'info' ELSE event_type END AS l FROM events) GROUP BY l""")
def level_normalization(spark, sf_dir):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'Critical' WHEN 2 THEN 'info' ELSE event_type END")
    df = read_table(spark, sf_dir, "events").select(raw.alias("raw_level"))
    return df.groupBy("raw_level", parsing.normalize_level(F.col("raw_level")).alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT event_id AS id, date_trunc('second', ts) AS at FROM events WHERE event_id % 4 < 3
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3""")
def flexible_timestamps(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.lit("soon"))
    )
    return e.select(F.col("event_id").alias("id"), parsing.timestamp(text).cast("timestamp_ntz").alias("at"))


@query(f"""WITH {KNOWN}, merged AS (
  SELECT p.id, CASE WHEN p.id % 3 = 0 THEN 'given' ELSE p.message END AS message, CASE WHEN p.id % 5 = 0 THEN 'TRACE' WHEN p.id % 3 = 0 THEN NULL ELSE p.level END AS level,
         CASE WHEN p.id % 3 = 0 THEN NULL ELSE p.parser END AS parser, source FROM parsed p)
SELECT id, message, level, parser, source FROM merged""")
def preprocess_merge(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    given = lines.select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("given")).otherwise(F.col("line")).alias("message"), F.col("line").alias("raw"),
        F.when(F.col("id") % 5 == 0, F.lit("TRACE")).alias("level"), F.lit(None).cast("timestamp").alias("ts"), "source",
        F.create_map().cast("map<string,string>").alias("attrs"),
    )
    out = preprocess.parse_stage()(given)
    return out.select("id", "message", "level", F.col("attrs")["parser"].alias("parser"), "source")


@query(f"""WITH {LINES_SQL} SELECT id, source, lower(event_type) AS message, event_type AS raw FROM log_lines WHERE event_type <> 'view'""")
def preprocess_filter(spark, sf_dir):
    lines = log_lines(spark, sf_dir).select("id", F.col("event_type").alias("message"), "source", F.col("event_type").alias("raw"))
    run = preprocess.pipeline([lambda df: df.withColumn("message", F.lower("message"))])
    run = preprocess.add_stage(run, preprocess.filter_stage(F.col("raw") != "view"), 0)
    return run(lines).select("id", "source", "message", "raw")


@query(f"""WITH {LINES_SQL} SELECT id, coalesce(message, raw, '') AS message, coalesce(raw, message, '') AS raw, coalesce(source, 'unknown') AS source
FROM (SELECT id, CASE WHEN id % 2 = 0 THEN line END AS message, CASE WHEN id % 3 > 0 THEN event_type END AS raw, CASE WHEN id % 5 > 0 THEN source END AS source FROM log_lines)""")
def adapt_records(spark, sf_dir):
    rows = log_lines(spark, sf_dir).selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN line END AS message", "CASE WHEN id % 3 > 0 THEN event_type END AS raw", "CASE WHEN id % 5 > 0 THEN source END AS source"
    )
    return preprocess.adapt(rows).select("id", "message", "raw", "source")


@query(f"""WITH {LINES_SQL} SELECT id, event_type || ' by user ' || user_id AS message, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM log_lines WHERE id % 8 = 0
UNION ALL SELECT id, line, NULL FROM log_lines WHERE id % 8 <> 0""")
def light_json(spark, sf_dir):
    out = preprocess.light_json(log_lines(spark, sf_dir), "line")
    return out.select("id", "message", "level")


@query("""SELECT doc_id AS id, sha256(coalesce(source, '') || '|' || text) AS key FROM documents""")
def assign_ids(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), preprocess.content_id("source", "text").alias("key"))


COMMITS = """commits AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'feat(' || event_type || ')!: add ' || user_id || ' (#' || (event_id % 50) || ')'
 WHEN 1 THEN 'fix: repair ' || event_type || ', closes #' || user_id || ' and #7' WHEN 2 THEN 'Docs(api) : say ' || event_type WHEN 3 THEN 'revert: undo ' || user_id ELSE 'no type here' END AS message FROM events)"""


@query(f"""WITH {COMMITS}, m AS (SELECT id, message, regexp_extract(message, '^(\\w+)(?:\\(([^)]+)\\))?\\s*(!)?\\s*:\\s*(.+)', ['type', 'scope', 'breaking', 'description']) AS p FROM commits)
SELECT id, CASE lower(p.type) WHEN 'feat' THEN 'Added' WHEN 'fix' THEN 'Fixed' WHEN 'revert' THEN 'Removed' ELSE 'Changed' END AS entry_type,
 nullif(p.scope, '') AS scope, p.breaking = '!' AS breaking, trim(p.description) AS description,
 array_to_string(list_transform(regexp_extract_all(message, '#(\\d+)', 1), lambda r: '#' || r), ',') AS refs FROM m WHERE p.type <> ''""")
def commit_parse(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        """CASE event_id % 5 WHEN 0 THEN concat('feat(', event_type, ')!: add ', user_id, ' (#', event_id % 50, ')')
        WHEN 1 THEN concat('fix: repair ', event_type, ', closes #', user_id, ' and #7') WHEN 2 THEN concat('Docs(api) : say ', event_type)
        WHEN 3 THEN concat('revert: undo ', user_id) ELSE 'no type here' END AS message""",
    )
    parsed = e.withColumn("c", changelog.parse_commit(F.col("message"))).where("c is not null")
    return parsed.select("id", "c.entry_type", "c.scope", "c.breaking", "c.description", F.array_join("c.refs", ",").alias("refs"))


@query("""WITH v AS (SELECT event_id AS id, (user_id % 4) AS major, (event_id % 9) AS minor, (event_id % 5) AS patch, CASE WHEN event_id % 3 = 0 THEN 'rc.' || (event_id % 4) END AS pre FROM events)
SELECT id, major::INTEGER AS major, minor::INTEGER AS minor, patch::INTEGER AS patch, pre AS prerelease, major || '.' || (minor + 1) || '.0' AS next_minor, (major + 1) || '.0.0' AS next_major, major = 1 AS fits_1 FROM v""")
def semver_parse(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "concat(user_id % 4, '.', event_id % 9, '.', event_id % 5, if(event_id % 3 = 0, concat('-rc.', event_id % 4), '')) as said"
    )
    v = e.withColumn("v", versions.parse(F.col("said")))
    return v.select(
        "id", "v.major", "v.minor", "v.patch", "v.prerelease", versions.bump(F.col("v"), "minor").alias("next_minor"),
        versions.bump(F.col("v"), "major").alias("next_major"), versions.compatible(F.col("v"), F.lit(1)).alias("fits_1"),
    )


@query("""SELECT * FROM (VALUES ('1.1.0', '2024-02-01', 'Added', 'two'), ('1.1.0', '2024-02-01', 'Fixed', 'three'), ('1.0.0', '2024-01-01', 'Added', 'one')) AS t(release, date, section, entry)""")
def changelog_forward_fill(spark, sf_dir):
    text = "# Log\n\n## [1.1.0] - 2024-02-01\n### Added\n- two\n### Fixed\n- three\n\n## [1.0.0] - 2024-01-01\n### Added\n- one\nprose\n"
    files = spark.createDataFrame([("CHANGELOG.md", text)], "path string, text string")
    return changelog.parse_changelog(files).select("release", "date", "section", "entry")


@query("""SELECT 'session_' || event_id || '_' || event_type || '_' || user_id || '.json' AS name, event_id::VARCHAR AS session_id, event_type || '_' || user_id AS labeler FROM events""")
def session_names(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").selectExpr("concat('session_', event_id, '_', event_type, '_', user_id, '.json') as name")
    parts = F.split(F.regexp_replace("name", r"\.json$", ""), "_")
    return e.select("name", parts[1].alias("session_id"), F.array_join(F.slice(parts, 3, 2**31 - 1), "_").alias("labeler"))
