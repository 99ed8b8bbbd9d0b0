"""Embeddings of texts: providers, each distinct text once, and a store on disk. Indexes are in ``index``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a provider is: made once for each task, it turns texts into a float32 matrix of unit rows.
Provider = Callable[[], Callable[[list[str]], np.ndarray]]


def mock_provider(dim: int = 384, seed_bytes: int = 4) -> Provider:
    """Deterministic vectors: a generator seeded by the first bytes of the text's SHA-256.

    Four are what the reference takes, and give its numbers; among 100 000 texts some two share them and so their vector. With 32 different texts have
    different vectors.
    """

    def make() -> Callable[[list[str]], np.ndarray]:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:seed_bytes], "big")
                v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
                norm = np.linalg.norm(v)
                out[i] = v / norm if norm > 0 else v
            return out

        return embed

    return make


def sentence_provider(model: str = "all-MiniLM-L6-v2") -> Provider:
    """A sentence-transformers model, loaded on first use in each worker; the package must be installed there."""

    def make() -> Callable[[list[str]], np.ndarray]:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)
        return lambda texts: np.asarray(loaded.encode(texts, normalize_embeddings=True), np.float32)

    return make


def chosen_text(normalized: Column, message: Column) -> Column:
    """What to embed: the normalised message if there is one."""
    return F.coalesce(F.nullif(normalized, F.lit("")), message)


def text_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def embed_distinct(df: DataFrame, text_col: str, provider: Provider, cached: DataFrame | None = None) -> DataFrame:
    """(text_key, embedding) of each distinct text that isn't in ``cached`` (text_key, embedding).

    A text is embedded once however often it stands there; hits are left out by an anti-join on the key.
    """
    texts = df.where(F.col(text_col).isNotNull()).select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).dropDuplicates(["text_key"])
    if cached is not None:
        texts = texts.join(cached.select("text_key"), "text_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = None
        for b in batches:
            embed = embed or provider()
            yield pd.DataFrame({"text_key": b["text_key"], "embedding": list(embed(b["text"].tolist()))})

    return texts.mapInPandas(run, "text_key string, embedding array<float>")


def embed_records(df: DataFrame, provider: Provider, cached: DataFrame | None = None, message: str = "message", normalized: str = "normalized") -> DataFrame:
    """``df`` with the embedding of each record's text; null for records without any."""
    have = set(df.columns)
    text = chosen_text(F.col(normalized) if normalized in have else F.lit(None).cast("string"), F.col(message))
    keyed = df.withColumn("__text", text).withColumn("text_key", text_key(F.col("__text")))
    known = embed_distinct(keyed, "__text", provider, cached)
    if cached is not None:
        known = known.unionByName(cached.select("text_key", "embedding"))
    return keyed.join(known, "text_key", "left").drop("__text", "text_key")


class VectorStore:
    """Vectors with metadata as a Parquet table: add appends, and updates are joins.

    Rows: id, embedding, message_preview (200 characters), source, level, ts, cluster_id, added_at.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def add(self, records: DataFrame, mode: str = "append") -> None:
        have = set(records.columns)
        col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
        records.select(
            F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"),
            F.substring(F.col("message") if "message" in have else F.lit(None), 1, 200).alias("message_preview"),
            col("source", "string"), col("level", "string"), col("ts", "timestamp"), col("cluster_id", "int"), F.current_timestamp().alias("added_at"),
        ).write.mode(mode).parquet(self.path)

    def size(self) -> int:
        return self.read().count()

    def get(self, id_: str) -> DataFrame:
        return self.read().where(F.col("id") == id_)

    def with_clusters(self, labels: DataFrame) -> DataFrame:
        """The table with cluster ids of ``labels`` (id, label); rows not named keep theirs."""
        named = labels.select(F.col("id").cast("string").alias("id"), F.col("label").alias("__label"))
        return self.read().join(named, "id", "left").withColumn("cluster_id", F.coalesce("__label", "cluster_id")).drop("__label")

    def save_as(self, path: str, labels: DataFrame | None = None) -> VectorStore:
        """Writes the table anew at another path; a table is never rewritten while it is read."""
        (self.read() if labels is None else self.with_clusters(labels)).write.mode("overwrite").parquet(path)
        return VectorStore(self.spark, path)

    def clear(self) -> None:
        """Deletes the data; the table stays, empty."""
        empty = self.spark.createDataFrame([], self.read().schema)
        empty.write.mode("overwrite").parquet(self.path)
