"""Reports of an analysis as JSON, Markdown or HTML. Only ranked, capped rows come to the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLUSTERS, MAX_NOVEL, FINDINGS = 20, 10, 3


def executive_summary(clusters: DataFrame, novelty: DataFrame, explanations: DataFrame) -> DataFrame:
    """(total_clusters, novel_patterns, high_severity, explanations): one row of counts."""
    a = clusters.agg(F.count("*").alias("total_clusters"))
    b = novelty.agg(F.count_if("is_novel").alias("novel_patterns"))
    c = explanations.agg(F.count_if(F.lower("severity").isin("high", "critical")).alias("high_severity"), F.count("*").alias("explanations"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def recommendations(silhouette: Column, davies_bouldin: Column, noise_ratio: Column, status: Column | None = None, new_clusters: Column | None = None) -> Column:
    """What to do about an evaluation, as an array of texts."""
    none = F.lit(None).cast("string")
    status = F.lower(status) if status is not None else none
    new = new_clusters if new_clusters is not None else F.lit(0)
    # The texts.
    return F.array_compact(
        F.array(
            F.when(silhouette < 0.25, "Low silhouette score indicates poor cluster separation. Consider adjusting min_cluster_size or min_samples parameters."),
            F.when(davies_bouldin > 2.0, "High Davies-Bouldin index suggests clusters may be overlapping. Try increasing cluster_selection_epsilon."),
            F.when(noise_ratio > 0.3, F.concat(F.lit("High noise ratio ("), F.format_string("%.1f", F.bround(noise_ratio * 100, 1)), F.lit("%). Consider lowering min_cluster_size to capture more patterns."))),
            F.when(status.isin("failed", "degraded"), F.concat(F.lit("Regression test "), status, F.lit(". Review misclassified records and consider retraining."))),
            F.when(new > 0, F.concat(F.lit("Found "), new.cast("string"), F.lit(" new clusters. Update golden dataset if these represent valid patterns."))),
        )
    )


def privacy_recommendations(level: str, encrypted: bool, retention_days: int, mode: str, pii_rate: Column) -> Column:
    # The texts.
    said = [
        (level != "maximum", "Consider using MAXIMUM privacy level for sensitive environments"), (not encrypted, "Enable at-rest encryption to protect stored data"),
        (retention_days == 0, "Set a data retention policy to automatically delete old data"), (mode == "store_all", "Switch to STORE_REDACTED mode to avoid storing PII"),
    ]
    high = F.when(pii_rate > 0.5, "High PII detection rate detected. Review log sources for PII leakage")
    return F.array_compact(F.array(*[F.lit(text) for hit, text in said if hit], high))


def collect(summary: DataFrame, clusters: DataFrame, novelty: DataFrame) -> dict:
    """The parts of a report: the summary's row, the largest clusters and the most novel rows."""
    top = clusters.orderBy(F.desc("size"), "label").limit(MAX_CLUSTERS).collect()
    novel = novelty.where("is_novel").orderBy(F.desc("score"), "id").limit(MAX_NOVEL).collect()
    return {"summary": summary.first().asDict(), "clusters": [r.asDict() for r in top], "novel": [r.asDict() for r in novel]}


def to_json(parts: dict) -> str:
    return json.dumps(parts, indent=2, default=str)


def to_markdown(parts: dict, title: str = "Log Analysis Report") -> str:
    s = parts["summary"]
    out = [f"# {title}", "", "## Executive Summary", "", "| Metric | Value |", "|--------|-------|"]
    names = {"total_clusters": "Total Clusters", "novel_patterns": "Novel Patterns", "high_severity": "High Severity Items", "explanations": "Explanations Generated"}
    out += [f"| {said} | {s.get(k, 0)} |" for k, said in names.items()]
    if parts["clusters"]:
        out += ["", "### Key Findings", ""]
        out += [f"{i}. **Cluster {c['label']}**: {c['size']} logs" for i, c in enumerate(parts["clusters"][:FINDINGS], 1)]
        out += ["", "## Cluster Analysis", "", "| Cluster | Size | Level | Source |", "|---|---|---|---|"]
        out += [f"| {c['label']} | {c['size']} | {c.get('common_level') or '-'} | {c.get('common_source') or '-'} |" for c in parts["clusters"]]
    if parts["novel"]:
        out += ["", "## Novel Patterns", ""]
        out += [f"- {n['id']}: {n['score']:.3f}" for n in parts["novel"]]
        more = s.get("novel_patterns", 0) - len(parts["novel"])
        out += [f"\n*... and {more} more*"] if more > 0 else []
    return "\n".join(out) + "\n"


def to_html(parts: dict, title: str = "Log Analysis Report") -> str:
    """The same as HTML; everything that comes from logs is escaped."""
    e = lambda x: html.escape(str(x if x is not None else "-"))
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    clusters = table(["Cluster", "Size", "Level", "Source"], [(c["label"], c["size"], c.get("common_level"), c.get("common_source")) for c in parts["clusters"]])
    novel = table(["Row", "Score"], [(n["id"], f"{n['score']:.3f}") for n in parts["novel"]])
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"
        f"<h2>Executive Summary</h2>{table(['Metric', 'Value'], parts['summary'].items())}<h2>Cluster Analysis</h2>{clusters}<h2>Novel Patterns</h2>{novel}</body></html>\n"
    )


def save(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
