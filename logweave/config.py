"""Settings of the engine with their defaults and checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields


@dataclass
class Embedding:
    model: str = "all-MiniLM-L6-v2"
    dimension: int = 384
    batch_size: int = 32


@dataclass
class Index:
    kind: str = "Flat"
    lists: int = 100
    probes: int = 10


@dataclass
class Clustering:
    algorithm: str = "hdbscan"
    min_cluster_size: int = 5
    min_samples: int = 3
    representatives: int = 5


@dataclass
class Novelty:
    threshold: float = 0.7
    k: int = 5
    use_density: bool = True


@dataclass
class Watch:
    poll_seconds: float = 10
    threshold: float = 0.5
    batch_lines: int = 100
    max_file_mb: int = 100
    patterns: str = "*.log,*.jsonl"


@dataclass
class Explaining:
    provider: str = "mock"
    model: str = "llama3.2"
    temperature: float = 0.1
    retries: int = 3


@dataclass
class Settings:
    embedding: Embedding = field(default_factory=Embedding)
    index: Index = field(default_factory=Index)
    clustering: Clustering = field(default_factory=Clustering)
    novelty: Novelty = field(default_factory=Novelty)
    watch: Watch = field(default_factory=Watch)
    explaining: Explaining = field(default_factory=Explaining)

    @classmethod
    def from_dict(cls, data: dict) -> Settings:
        """Settings from nested dictionaries; an unknown name or a bad value is an error that says where."""
        out = cls()
        problems = []
        for section, values in data.items():
            part = getattr(out, section, None)
            if part is None or not isinstance(values, dict):
                problems.append(f"{section}: no such section")
                continue
            known = {f.name for f in fields(part)}
            for key, value in values.items():
                if key in known:
                    setattr(part, key, value)
                else:
                    problems.append(f"{section}.{key}: no such setting")
        problems += out.problems()
        if problems:
            raise ValueError("; ".join(problems))
        return out

    def problems(self) -> list[str]:
        """What is wrong with the values, one line each."""
        whole = lambda v, least: isinstance(v, int) and not isinstance(v, bool) and v >= least
        share = lambda v: isinstance(v, (int, float)) and 0 <= v <= 1
        checks = [
            ("embedding.dimension", whole(self.embedding.dimension, 1), "a positive whole number"),
            ("embedding.batch_size", whole(self.embedding.batch_size, 1), "a positive whole number"),
            ("index.kind", self.index.kind in ("Flat", "IVF", "IVFFlat", "HNSW"), "Flat, IVF, IVFFlat or HNSW"),
            ("index.lists", whole(self.index.lists, 1), "a positive whole number"),
            ("index.probes", whole(self.index.probes, 1), "a positive whole number"),
            ("clustering.algorithm", self.clustering.algorithm in ("hdbscan", "mock"), "hdbscan or mock"),
            ("clustering.min_cluster_size", whole(self.clustering.min_cluster_size, 2), "a whole number of at least 2"),
            ("clustering.min_samples", whole(self.clustering.min_samples, 0), "a whole number"),
            ("novelty.threshold", share(self.novelty.threshold), "between 0 and 1"),
            ("novelty.k", whole(self.novelty.k, 1), "a positive whole number"),
            ("watch.threshold", share(self.watch.threshold), "between 0 and 1"),
            ("watch.batch_lines", whole(self.watch.batch_lines, 1), "a positive whole number"),
            ("explaining.retries", whole(self.explaining.retries, 1), "a positive whole number"),
        ]
        return [f"{name} must be {what}" for name, ok, what in checks if not ok]

    def to_dict(self) -> dict:
        return asdict(self)
