"""Prompts for explanations, a mock answer, and the parsing of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities, and the four prompts with named holes.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CLUSTER_PROMPT = """You are an expert log analyst helping on-call engineers understand log patterns.

Analyze the following cluster of <n_logs> similar log messages:

**Representative Log Messages:**
<log_messages>

**Cluster Metadata:**
- Cluster Size: <cluster_size>
- Common Log Level: <common_level>
- Time Range: <time_range>

Provide a structured analysis in the following JSON format:
{
    "summary": "Brief 1-2 sentence description of what this log pattern represents",
    "root_cause": "Most likely root cause of these log messages",
    "severity": "critical|high|medium|low|info",
    "suggested_actions": ["action 1", "action 2", "action 3"],
    "confidence": 0.0 to 1.0
}

Important:
- Be concise and actionable
- Focus on what an on-call engineer needs to know
- Suggest specific debugging steps
- Rate severity based on production impact

Respond with ONLY the JSON object, no additional text."""
NOVELTY_PROMPT = """You are an expert log analyst helping on-call engineers identify unusual patterns.

A novel log pattern has been detected that doesn't match known patterns:

**Novel Log Message:**
<log_message>

**Novelty Score:** <novelty_score> (higher = more unusual, threshold: <threshold>)

**Context:**
- Detection Algorithm: k-NN density-based
- This log is significantly different from the baseline of <n_reference> known patterns

Provide a structured analysis in the following JSON format:
{
    "summary": "Brief explanation of what makes this log unusual",
    "root_cause": "Possible cause for this unexpected pattern",
    "severity": "critical|high|medium|low|info",
    "suggested_actions": ["action 1", "action 2", "action 3"],
    "confidence": 0.0 to 1.0
}

Important:
- Explain WHY this log is unusual compared to normal patterns
- Consider if this might indicate a new type of error or attack
- Suggest investigation steps
- Rate severity based on potential impact

Respond with ONLY the JSON object, no additional text."""
ERROR_PROMPT = """You are an expert log analyst diagnosing errors in production systems.

Analyze the following error log:

**Error Message:**
<error_message>

**Error Details:**
- Log Level: <log_level>
- Source: <source>
- Timestamp: <timestamp>
- Additional Context: <context>

Provide a structured analysis in the following JSON format:
{
    "summary": "Brief explanation of the error",
    "root_cause": "Most likely cause of this error",
    "severity": "critical|high|medium|low|info",
    "suggested_actions": ["action 1", "action 2", "action 3"],
    "related_patterns": ["pattern 1", "pattern 2"],
    "confidence": 0.0 to 1.0
}

Important:
- Focus on actionable debugging steps
- Consider common causes for this type of error
- Suggest both immediate actions and long-term fixes

Respond with ONLY the JSON object, no additional text."""
SUMMARY_PROMPT = """You are an expert log analyst creating executive summaries for incident reviews.

Summarize the following log analysis results:

**Overview:**
- Total Logs Analyzed: <total_logs>
- Clusters Found: <n_clusters>
- Novel Patterns Detected: <n_novel>

**Top Clusters:**
<cluster_summaries>

**Novel Patterns:**
<novelty_summaries>

Provide a structured summary in the following JSON format:
{
    "summary": "Executive summary of the log analysis (2-3 sentences)",
    "key_findings": ["finding 1", "finding 2", "finding 3"],
    "severity": "critical|high|medium|low|info",
    "suggested_actions": ["action 1", "action 2", "action 3"],
    "confidence": 0.0 to 1.0
}

Important:
- Focus on the most important patterns requiring attention
- Prioritize by severity and frequency
- Make recommendations actionable

Respond with ONLY the JSON object, no additional text."""


def fill(prompt: str, **holes: Column) -> Column:
    """The prompt with its named holes filled; what fills one is never searched for others."""
    import re

    parts = re.split(r"<(\w+)>", prompt)
    cols = [F.lit(p) if i % 2 == 0 else F.coalesce(holes[p].cast("string"), F.lit("unknown")) for i, p in enumerate(parts)]
    return F.concat(*cols)


def bullets(messages: Column, most: int = 10) -> Column:
    """At most ``most`` messages as a list."""
    return F.array_join(F.transform(F.slice(messages, 1, most), lambda m: F.concat(F.lit("- "), m)), "\n")


def mock_answer(prompt: Column) -> Column:
    """A struct (text, prompt_tokens, completion_tokens): the same answer for all but its severity."""
    low = F.lower(prompt)
    severity = F.when(low.contains("error") | low.contains("critical"), "high").when(low.contains("warning"), "medium").when(low.contains("info"), "low").otherwise("medium")
    text = F.concat(
        F.lit('{"summary": "Mock analysis of the provided log patterns.", "root_cause": "This is a mock root cause analysis for testing purposes.", "severity": "'),
        severity,
        F.lit('", "suggested_actions": ["Check application logs for more context", "Review recent deployments", "Monitor system metrics"], "related_patterns": ["connection_error", "timeout"], "confidence": 0.85}'),
    )
    tokens = lambda t: 2 * F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.struct(text.alias("text"), tokens(prompt).alias("prompt_tokens"), tokens(text).alias("completion_tokens"))


ANSWER = "summary string, root_cause string, suggested_actions array<string>, severity string, confidence double, related_patterns array<string>"


def parse_answer(text: Column) -> Column:
    """The struct of an answer; null without a JSON object in it. An unknown severity is info, the default confidence 0.5."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    a = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), ANSWER)
    level = F.lower(a["severity"])
    none = F.expr("cast(array() as array<string>)")
    return F.when(
        a.isNotNull() & F.try_parse_json(body).isNotNull(),
        F.struct(
            F.coalesce(a["summary"], F.lit("")).alias("summary"), a["root_cause"].alias("root_cause"),
            F.coalesce(a["suggested_actions"], none).alias("suggested_actions"), F.when(level.isin(SEVERITIES), level).otherwise("info").alias("severity"),
            F.coalesce(a["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(a["related_patterns"], none).alias("related_patterns"),
        ),
    )


def ask(df: DataFrame, prompt_col: str, provider: Callable[[], Callable[[str], str]], attempts: int = 3, base: float = 1.0) -> DataFrame:
    """``df`` with ``answer`` and ``error`` from a provider: a client made once for each task.

    A failed call is tried again after base * 2 ** n seconds; after the last try the
    error is kept in its row and the job goes on.
    """
    fields = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        client = provider()

        def call(prompt: str) -> tuple[str | None, str | None]:
            said = None
            for n in range(attempts):
                try:
                    return client(prompt), None
                except Exception as e:  # a provider may raise anything; the row keeps it
                    said = f"{type(e).__name__}: {e}"
                    if n + 1 < attempts:
                        time.sleep(base * 2**n)
            return None, said

        for b in batches:
            answers = [call(p) for p in b[prompt_col]]
            yield b.assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    return df.mapInPandas(run, fields)
