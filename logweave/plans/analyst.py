"""The analyst's SQL over structured log rows. 'Now' is the latest row's time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .lines import RECORDS_SQL, records
from .registry import query


def _run(spark, sf_dir, sql):
    """Runs SQL over the view ``records``; durations are text like '2.5s', as loggers write them."""
    name = "logweave_records"
    records(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(sql.replace("records", name))


def _both(name, spark_sql, duck_sql=None):
    query(f"WITH {RECORDS_SQL} {duck_sql or spark_sql}", name=name)(lambda spark, sf_dir: _run(spark, sf_dir, spark_sql))


_both("errors_last_hour", "SELECT id, ts, service, msg FROM records WHERE level = 'error' AND ts > (SELECT max(ts) FROM records) - INTERVAL '1' HOUR")
_both(
    "count_by_service_level",
    "SELECT service, level, count(*) AS cnt FROM records WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM records) GROUP BY service, level ORDER BY cnt DESC",
)
_both(
    "slow_ops_top100",
    "SELECT id, msg, duration, request_id FROM records WHERE CAST(replace(duration, 's', '') AS DOUBLE) > 5.0 ORDER BY CAST(replace(duration, 's', '') AS DOUBLE) DESC, id LIMIT 100",
)
_both(
    "error_distribution",
    "SELECT error_code, count(*) AS cnt FROM records WHERE level = 'error' AND CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM records) GROUP BY error_code ORDER BY cnt DESC",
)
_both(
    "avg_duration_having",
    "SELECT msg, round(avg(CAST(replace(duration, 's', '') AS DOUBLE)), 4) AS avg_duration FROM records WHERE duration IS NOT NULL GROUP BY msg HAVING avg(CAST(replace(duration, 's', '') AS DOUBLE)) > 1.0 ORDER BY avg_duration DESC",
)
_both("request_trace", "SELECT id, ts, msg, n FROM records WHERE request_id = 'req-42' ORDER BY ts")
_both(
    "hourly_volume",
    "SELECT date_trunc('hour', ts) AS hour, CAST(sum(n) AS BIGINT) AS total_logs FROM records WHERE msg = 'batch_completed' GROUP BY 1 ORDER BY 1",
)


@query(f"WITH {RECORDS_SQL} SELECT level, count(*) AS rows_out, count(error_code) AS with_code, count(DISTINCT source) AS sources FROM records GROUP BY level")
def level_summary(spark, sf_dir):
    return records(spark, sf_dir).groupBy("level").agg(
        F.count("*").alias("rows_out"), F.count("error_code").alias("with_code"), F.countDistinct("source").alias("sources")
    )
