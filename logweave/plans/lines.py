"""Log-shaped views of the driver's tables, in Spark and in DuckDB.

``events`` has no text, so raw lines in six formats are printed from it: the
parsers then have a known answer for each line. ``LINES_SQL`` is the same in
DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line, source, event_type, user_id): a line for each event, its format by id modulo 8."""
    e = read_table(spark, sf_dir, "events")
    at = lambda pattern: F.date_format("ts", pattern)
    u, cents, kind = F.col("user_id").cast("string"), F.round(F.col("value") * 100).cast("long").cast("string"), F.col("event_type")
    loud = kind == "error"
    lines = [
        F.concat(F.lit('{"message": "'), kind, F.lit(" by user "), u, F.lit('", "level": "'), F.when(loud, "error").otherwise("info"), F.lit('", "timestamp": "'), at("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}')),
        F.concat(at("MMM d HH:mm:ss"), F.lit(" host"), u, F.lit(" app["), cents, F.lit("]: "), kind, F.when(loud, F.lit(" failed for 10.0.0.")).otherwise(F.lit(" done for 10.0.0.")), u),
        F.concat(F.lit("10.0.1."), u, F.lit(" - - ["), at("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /api/'), kind, F.lit('/'), cents, F.lit(' HTTP/1.1" '), F.when(loud, "500").when(kind == "view", "404").otherwise("200"), F.lit(" "), cents, F.lit(' "-" "curl/7.68.0"')),
        F.concat(at("yyyy/MM/dd HH:mm:ss"), F.lit(" ["), F.when(loud, "error").otherwise("notice"), F.lit("] "), u, F.lit("#"), cents, F.lit(": *9 upstream "), kind, F.lit(" timed out")),
        F.when(loud, F.concat(F.lit("ValueError: bad value "), cents)).otherwise(F.concat(F.lit('  File "/app/'), kind, F.lit('.py", line '), u, F.lit(", in run"))),
        F.concat(at("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(loud, " ERROR ").otherwise(" WARNING "), kind, F.lit(" request id=550e8400-e29b-41d4-a716-4466554"), F.lpad(u, 5, "0"), F.lit(" pid="), u, F.lit(" to user"), u, F.lit("@example.com via https://h.example.com/"), kind),
        F.concat(F.lit("["), F.when(loud, "CRITICAL").otherwise("DEBUG"), F.lit("] "), kind, F.lit(" at /var/log/app/"), kind, F.lit(".log:"), F.substring(F.concat(cents, F.lit("00")), 1, 3)),
        F.concat(kind, F.lit(" count "), F.lit("12345"), cents),
    ]
    line = F.lit(None).cast("string")
    for i, made in reversed(list(enumerate(lines))):
        line = F.when(F.col("event_id") % 8 == i, made).otherwise(line)
    return e.select(
        F.col("event_id").alias("id"), line.alias("line"), F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        "event_type", "user_id",
    )


LINES_SQL = """log_lines AS (
  SELECT event_id AS id, 'app-' || (user_id % 5)::VARCHAR AS source, event_type, user_id, CASE event_id % 8
    WHEN 0 THEN '{"message": "' || event_type || ' by user ' || user_id || '", "level": "' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || '", "timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}'
    WHEN 1 THEN strftime(ts, '%b %-d %H:%M:%S') || ' host' || user_id || ' app[' || c || ']: ' || event_type || CASE WHEN event_type = 'error' THEN ' failed for 10.0.0.' ELSE ' done for 10.0.0.' END || user_id
    WHEN 2 THEN '10.0.1.' || user_id || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /api/' || event_type || '/' || c || ' HTTP/1.1" ' || CASE event_type WHEN 'error' THEN '500' WHEN 'view' THEN '404' ELSE '200' END || ' ' || c || ' "-" "curl/7.68.0"'
    WHEN 3 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') || ' [' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'notice' END || '] ' || user_id || '#' || c || ': *9 upstream ' || event_type || ' timed out'
    WHEN 4 THEN CASE WHEN event_type = 'error' THEN 'ValueError: bad value ' || c ELSE '  File "/app/' || event_type || '.py", line ' || user_id || ', in run' END
    WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || CASE WHEN event_type = 'error' THEN ' ERROR ' ELSE ' WARNING ' END || event_type || ' request id=550e8400-e29b-41d4-a716-4466554' || lpad(user_id::VARCHAR, 5, '0') || ' pid=' || user_id || ' to user' || user_id || '@example.com via https://h.example.com/' || event_type
    WHEN 6 THEN '[' || CASE WHEN event_type = 'error' THEN 'CRITICAL' ELSE 'DEBUG' END || '] ' || event_type || ' at /var/log/app/' || event_type || '.log:' || substr(c || '00', 1, 3)
    ELSE event_type || ' count 12345' || c END AS line
  FROM (SELECT *, round(value * 100)::BIGINT::VARCHAR AS c FROM events)
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, level, source, service, msg, duration, n): structured log rows from events."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts",
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warn").otherwise("info").alias("level"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("service"),
        F.when(F.col("event_id") % 3 == 0, "batch_completed").otherwise(F.col("event_type")).alias("msg"),
        F.concat(F.col("value").cast("string"), F.lit("s")).alias("duration"),
        F.get_json_object("props", "$.k").cast("int").alias("n"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("user_id") % 11).cast("string"))).alias("error_code"),
        F.concat(F.lit("req-"), (F.col("event_id") % 97).cast("string")).alias("request_id"),
    )


RECORDS_SQL = """records AS (
  SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' ELSE 'info' END AS level,
         'user-' || user_id AS source, 'svc-' || (user_id % 7) AS service,
         CASE WHEN event_id % 3 = 0 THEN 'batch_completed' ELSE event_type END AS msg,
         value::VARCHAR || 's' AS duration, json_extract_string(props, '$.k')::INTEGER AS n,
         CASE WHEN event_type = 'error' THEN 'E' || (user_id % 11) END AS error_code, 'req-' || (event_id % 97) AS request_id
  FROM events
)"""
