"""Synthetic logs: weighted patterns and levels from keyed hashes, the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the patterns and levels, sources, and sizes of the presets.
PATTERN_WEIGHTS = {"http_request": 0.4, "database_query": 0.2, "auth_event": 0.15, "system_event": 0.15, "error_stack": 0.1}
LEVEL_WEIGHTS = {"DEBUG": 0.1, "INFO": 0.5, "WARNING": 0.2, "ERROR": 0.15, "CRITICAL": 0.05}
SOURCES = ["/var/log/app/web.log", "/var/log/app/api.log", "/var/log/app/worker.log"]
SCALES = {"small": 1_000, "medium": 10_000, "large": 100_000, "huge": 1_000_000}


def _draw(seed: int, name: str) -> Column:
    """A number in [0, 1) for a row and a purpose."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}-{name}"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)


def _pick(u: Column, weights: dict[str, float]) -> Column:
    total, at, edges = sum(weights.values()), 0.0, []
    for name, w in weights.items():
        at += w / total
        edges.append((at, name))
    out = F.lit(edges[-1][1])
    for edge, name in reversed(edges[:-1]):
        out = F.when(u < edge, name).otherwise(out)
    return out


def _one_of(u: Column, values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.floor(u * len(values)).cast("int")]


def generate(
    spark: SparkSession, n: int, seed: int = 42, patterns: dict[str, float] | None = None, levels: dict[str, float] | None = None,
    sources: list[str] | None = None, hours: int = 24, start: str = "2024-01-15T00:00:00Z",
) -> DataFrame:
    """(id, message, level, source, ts, raw, pattern): ``n`` rows, no row depending on another."""
    d = lambda name: _draw(seed, name)
    num = lambda name, low, high: (F.floor(d(name) * (high - low)) + low).cast("string")
    word = lambda name: F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-{name}"), F.col("id").cast("string"))), 1, 8)
    ip = F.concat_ws(".", num("a", 1, 255), num("b", 0, 256), num("c", 0, 256), num("e", 1, 255))
    service = _one_of(d("service"), ["auth", "billing", "search", "gateway"])
    made = {
        "http_request": F.concat(_one_of(d("verb"), ["GET", "POST", "PUT", "DELETE"]), F.lit(" /api/v1/"), service, F.lit("/"), num("path", 1, 9999), F.lit(" "), _one_of(d("status"), ["200", "200", "201", "404", "500"]), F.lit(" "), num("ms", 1, 2000), F.lit("ms from "), ip),
        "database_query": F.concat(F.lit("Query executed: "), _one_of(d("op"), ["SELECT", "INSERT", "UPDATE"]), F.lit(" on "), service, F.lit(" - "), num("ms", 1, 500), F.lit("ms, "), num("rows", 0, 10000), F.lit(" rows affected")),
        "auth_event": F.concat(F.lit("Auth login "), F.when(d("ok") > 0.1, "successful").otherwise("failed"), F.lit(" for user="), word("user"), F.lit(" from ip="), ip),
        "system_event": F.concat(F.lit("Service "), service, _one_of(d("did"), [" started", " stopped", " reloaded"])),
        "error_stack": F.concat(_one_of(d("error"), ["ValueError", "TimeoutError", "KeyError"]), F.lit(": Operation failed: "), word("what"), F.lit('\nTraceback:\n  File "/app/src/'), word("file"), F.lit('.py", line '), num("line", 1, 500), F.lit(", in run")),
    }
    rows = spark.range(n).withColumns(
        {
            "pattern": _pick(d("pattern"), patterns or PATTERN_WEIGHTS), "level": _pick(d("level"), levels or LEVEL_WEIGHTS), "source": _one_of(d("source"), sources or SOURCES),
            "ts": F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(start))) + F.floor(d("time") * hours * 3600)),
        }
    )
    message = F.lit("")
    for name, text in made.items():
        message = F.when(F.col("pattern") == name, text).otherwise(message)
    rows = rows.withColumn("message", message)
    raw = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "level", "message")
    return rows.select("id", "message", "level", "source", "ts", raw.alias("raw"), "pattern")


def preset(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    return generate(spark, SCALES[name], seed)
