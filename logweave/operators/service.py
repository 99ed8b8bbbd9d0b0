"""Whole analyses of a batch of records: preprocess, embed, store, then cluster or detect novelty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..session import held
from . import clusters, embedding, hdbscan, novelty
from .preprocess import Pipeline, adapt, default_pipeline


@dataclass
class Analysis:
    """Settings, an embedding provider and preprocessing stages; each method is a plan over its input."""

    settings: Settings
    provider: embedding.Provider
    stages: Pipeline | None = None

    def embedded(self, rows: DataFrame) -> DataFrame:
        """Adapted, preprocessed and embedded records: vec_id (a hash of the id), id, message, normalized, level, source, ts, embedding."""
        have = set(rows.columns)
        rows = adapt(rows)
        for name, kind in (("id", "string"), ("level", "string"), ("ts", "timestamp"), ("attrs", "map<string,string>")):
            rows = rows.withColumn(name, (F.col(name) if name in have else F.lit(None)).cast(kind))
        # Held: the texts are read twice, and their masks would be worked out anew for each use of them.
        done = held((self.stages or default_pipeline())(rows))
        out = embedding.embed_records(done, self.provider)
        return out.where(F.col("embedding").isNotNull()).withColumn("vec_id", F.xxhash64("id"))

    def store(self, records: DataFrame, store: embedding.VectorStore) -> DataFrame:
        """Computes the records once, in the folder that all executors share, and writes them to the store; nothing is embedded twice."""
        kept = held(records)
        store.add(kept)
        return kept

    def cluster(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(assignments (vec_id, label), summaries) of embedded records, under other settings as often as asked."""
        c = self.settings.clustering
        if c.algorithm == "mock":
            labels = clusters.mock_labels(records, 8)
        else:
            # Held, as the summaries read it several times.
            labels = held(hdbscan.cluster(records, min_cluster_size=c.min_cluster_size, min_samples=c.min_samples))
        labelled = records.join(labels.withColumnRenamed("id", "__vec"), F.col("vec_id") == F.col("__vec")).drop("__vec")
        return labels.withColumnRenamed("id", "vec_id"), clusters.summaries(labelled, k=c.representatives)

    def novel(self, records: DataFrame, reference: DataFrame | None = None) -> DataFrame:
        """(id, score, is_novel, explanation); without a reference the batch is measured against itself."""
        n = self.settings.novelty
        base = records if reference is None else reference
        fitted = novelty.fit(base, n.k, n.use_density, distinct=True)
        return novelty.detect(novelty.score(records, base, fitted, distinct=True), n.threshold)
