"""Streaming jobs: micro-batches, windowed volume, and watching logs for novel lines.

A trigger replaces size-or-time flushing, the source's limits replace the bounded
buffer (Spark pulls, so a slow sink holds the source back and nothing is
dropped), and a checkpoint makes an interrupted batch run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsing import ParserRegistry, parse_lines
from ..operators import routing


def micro_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = 5, dead_letters: str | None = None) -> StreamingQuery:
    """Calls ``handle(batch, number)`` on micro-batches, every so many seconds or, with None, on what there is.

    A batch that fails is written to ``dead_letters``, if given, and the stream goes on;
    otherwise the query fails and the batch runs again on restart.
    """

    def each(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception:
            if dead_letters is None:
                raise
            batch.withColumn("batch", F.lit(number)).write.mode("append").json(dead_letters)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed_volume(stream: DataFrame, ts_col: str = "ts", count: Column | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(hour, total_logs) in windows of event time; rows later than the watermark are dropped by the engine."""
    total = F.count("*") if count is None else F.sum(count)
    by = stream.withWatermark(ts_col, late).groupBy(F.window(ts_col, window).alias("w"))
    return by.agg(total.alias("total_logs")).select(F.col("w.start").alias("hour"), "total_logs")


def watched(lines: DataFrame, score: Callable[[Column], Column] | None = None, threshold: float = 0.5, registry: ParserRegistry | None = None) -> DataFrame:
    """Alert events of a stream of lines: parsed, scored (0 without a scorer), those at or over the threshold."""
    parsed = parse_lines(lines.where(F.length("line") > 0), "line", registry)
    scored = parsed.withColumn("score", F.lit(0.0) if score is None else score(F.col("line")))
    return routing.events_from_scores(scored, threshold)


def watch_and_route(
    lines: DataFrame, rules: list[routing.Rule], send: Callable[[DataFrame], None], checkpoint: str,
    score: Callable[[Column], Column] | None = None, threshold: float = 0.5, defaults: list[str] | None = None, seconds: float | None = 10,
) -> StreamingQuery:
    """Scores, routes and hands each batch of (event, target) rows to ``send``."""
    routed = routing.route(watched(lines, score, threshold), rules, defaults)
    targets = routed.withColumn("target", F.explode("targets"))
    return micro_batches(targets, lambda batch, _: send(batch), checkpoint, seconds)


def embedded(stream: DataFrame, provider, text_col: str = "message") -> DataFrame:
    """A stream with an embedding of each row's text: a provider in each task, texts in Arrow batches."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T

    fields = T.StructType([*stream.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = provider()
        for b in batches:
            yield b.assign(embedding=list(embed(b[text_col].fillna("").tolist())))

    return stream.mapInPandas(run, fields)


def limited(stream: DataFrame, most: int, window: str = "1 minute", ts_col: str = "ts", by: str = "target") -> DataFrame:
    """(window start, by, sent, held back): counts against a limit for each notifier and window of event time."""
    counts = stream.withWatermark(ts_col, window).groupBy(F.window(ts_col, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, F.least("n", F.lit(most)).alias("sent"), F.greatest(F.col("n") - most, F.lit(0)).alias("held_back"))


def status(query: StreamingQuery) -> dict:
    """Counts and state of a running query, from its last progress."""
    last = query.lastProgress or {}
    return {
        "active": query.isActive, "message": query.status["message"], "batch": last.get("batchId"),
        "rows": last.get("numInputRows", 0), "rows_per_second": last.get("processedRowsPerSecond", 0.0),
    }
