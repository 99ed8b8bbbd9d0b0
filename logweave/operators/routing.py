"""Alert events, routing rules and notifier plumbing."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priorities from least to most urgent, and the least scores of the upper four.
PRIORITIES = ["info", "low", "medium", "high", "critical"]
PRIORITY_SCORES = [(0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low")]


def priority(score: Column) -> Column:
    out = F.lit("info")
    for least, name in reversed(PRIORITY_SCORES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def ordinal(name: Column) -> Column:
    """The rank of a priority, null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), name), F.lit(0).cast("long")) - 1


@dataclass(frozen=True)
class Rule:
    """Where events go. ``metadata`` maps keys to a value, or to (operator, value).

    Operators: equals, contains, regex, in, not_in, gte, lte. A missing value fails
    the comparisons; numbers compare as numbers.
    """

    name: str
    notifiers: list[str]
    priorities: list[str] | None = None
    least_priority: str | None = None
    tags: list[str] | None = None
    source_pattern: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    stop: bool = False

    def matches(self) -> Column:
        """A predicate on events (priority, source, tags, metadata)."""
        out = F.lit(self.enabled)
        if self.priorities is not None:
            out &= F.col("priority").isin(self.priorities) if self.priorities else F.lit(False)
        if self.least_priority is not None:
            out &= ordinal(F.col("priority")) >= PRIORITIES.index(self.least_priority)
        if self.tags is not None:
            out &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in self.tags])) if self.tags else F.lit(False)
        if self.source_pattern is not None:
            out &= F.col("source").rlike(self.source_pattern)
        for key, expected in self.metadata.items():
            out &= match_value(F.try_element_at("metadata", F.lit(key)), expected)
        return F.coalesce(out, F.lit(False))


def match_value(actual: Column, expected: Any) -> Column:
    op, value = expected if isinstance(expected, tuple) else ("equals", expected)
    if op in ("in", "not_in"):
        known = actual.isin([str(v) for v in value]) if value else F.lit(False)
        known = F.coalesce(known, F.lit(False))
        return known if op == "in" else ~known
    return {
        "equals": lambda: actual == str(value),
        "contains": lambda: actual.contains(str(value)),
        "regex": lambda: actual.rlike(str(value)),
        "gte": lambda: actual.try_cast("double") >= float(value),
        "lte": lambda: actual.try_cast("double") <= float(value),
    }[op]()


def route(events: DataFrame, rules: list[Rule], defaults: list[str] | None = None) -> DataFrame:
    """Adds matched (rule names in order) and targets (distinct notifiers).

    Rules are a configured list, tried in order up to and including the first match
    that stops; events without a match go to ``defaults``. One projection: no
    join and no shuffle, whatever the number of events.
    """
    hits = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(r.name).alias("name"), F.lit(r.stop).alias("stop"), F.array(*[F.lit(n) for n in r.notifiers]).cast("array<string>").alias("to"), r.matches().alias("hit"))
            for i, r in enumerate(rules)
        ]
    )
    df = events.withColumn("__hits", F.filter(hits, lambda h: h["hit"]) if rules else F.lit(None))
    last = F.array_min(F.transform(F.filter("__hits", lambda h: h["stop"]), lambda h: h["pos"]))
    df = df.withColumn("__hits", F.filter("__hits", lambda h: last.isNull() | (h["pos"] <= last))) if rules else df
    none = F.expr("cast(array() as array<string>)")
    names = F.transform("__hits", lambda h: h["name"]) if rules else none
    targets = F.array_distinct(F.flatten(F.transform("__hits", lambda h: h["to"]))) if rules else none
    fallback = F.array(*[F.lit(d) for d in defaults]) if defaults else none
    return df.withColumn("matched", names).withColumn("targets", F.when(F.size("matched") > 0, targets).otherwise(fallback)).drop("__hits")


def events_from_scores(rows: DataFrame, threshold: float = 0.5, message: str = "message", score: str = "score", source: str = "source") -> DataFrame:
    """Alert events of rows at or over the threshold: title, message (500 characters), priority, metadata, tags."""
    text = F.col(message)
    return rows.where(F.col(score) >= threshold).select(
        F.sha2(F.concat_ws("|", F.col(source), text), 256).alias("event_id"),
        F.concat(F.lit("Novel pattern: "), F.substring(text, 1, 100)).alias("title"),
        F.substring(text, 1, 500).alias("message"), priority(F.col(score)).alias("priority"), F.col(source).alias("source"),
        F.create_map(F.lit("novelty_score"), F.round(score, 4).cast("string")).alias("metadata"), F.array(F.lit("novelty")).alias("tags"),
    )


def payload(kind: str) -> Column:
    """The JSON body a notifier of a kind sends for an event."""
    meta = F.col("metadata")
    shapes = {
        "webhook": F.struct("event_id", "title", "message", "priority", "source", meta.alias("metadata"), F.col("tags")),
        "slack": F.struct(
            F.concat(F.lit("["), F.upper("priority"), F.lit("] "), F.col("title")).alias("text"),
            F.array(F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), F.col("message").alias("text")).alias("text"))).alias("blocks"),
        ),
        "email": F.struct(F.concat(F.lit("["), F.upper("priority"), F.lit("] "), F.col("title")).alias("subject"), F.col("message").alias("body")),
        "github": F.struct(
            F.col("title"), F.concat(F.col("message"), F.lit("\n\nSource: "), F.col("source")).alias("body"),
            F.slice(F.array_union(F.array(F.concat(F.lit("priority:"), F.col("priority"))), F.col("tags")), 1, 5).alias("labels"),
        ),
    }
    return F.to_json(shapes[kind])


def template(text: str, fields: list[str]) -> Column:
    """A text with $name replaced by the named columns; unknown names stay."""
    out = F.lit(text)
    for f in sorted(fields, key=len, reverse=True):
        out = F.replace(out, F.lit(f"${f}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
    return out


def new_issues(events: DataFrame, open_issues: DataFrame, title: str = "title") -> DataFrame:
    """Events without an open issue of their title, one for each title (the first by id)."""
    from pyspark.sql import Window

    fresh = events.join(open_issues.select(title).distinct(), title, "left_anti")
    w = Window.partitionBy(title).orderBy("event_id")
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def health(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(status): the worst of the checks' statuses, unhealthy over degraded over healthy."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = F.max(rank)
    said = F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy")
    return (checks.groupBy(*by) if by else checks.groupBy()).agg(said.alias("status"))


def notifier_health(notifiers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """healthy if all are enabled and working, unhealthy if none is, else degraded; degraded without any."""
    ok = F.count_if(F.col("healthy"))
    n = F.count("*")
    said = F.when(n == 0, "degraded").when(ok == n, "healthy").when(ok == 0, "unhealthy").otherwise("degraded")
    return (notifiers.groupBy(*by) if by else notifiers.groupBy()).agg(said.alias("status"), n.alias("total"), ok.alias("working"))


def retry_delay(attempt: Column, base: float = 1.0) -> Column:
    """Seconds before the attempt after this one: base * 2 ** (attempt - 1)."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
