"""Options of the engine, with the defaults of the small profile."""

from __future__ import annotations

from dataclasses import dataclass, field


def as_bool(value: object, default: bool = False) -> bool:
    """Booleans from settings: 1, true, yes, y and on count as true."""
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in {"1", "true", "yes", "y", "on"}


@dataclass(frozen=True)
class AnalyzerConfig:
    min_len: int = 2
    lowercase: bool = True
    remove_stopwords: bool = True
    stem: bool = False
    #: both act on the text before it is cut into tokens
    ascii_fold: bool = False
    number_normalize: bool = False


@dataclass(frozen=True)
class FieldConfig:
    weight: float = 1.0
    avg_len: float = 100.0


@dataclass(frozen=True)
class SearchConfig:
    num_docs: int = 32_000
    postings_cut: int = 1000
    max_results: int = 10
    k1: float = 1.5
    b: float = 0.75
    fields: dict[str, FieldConfig] = field(default_factory=lambda: {"title": FieldConfig(2.0, 20), "body": FieldConfig(1.0, 80), "url": FieldConfig(1.5, 10)})
    max_phrase_len: int = 5
    leaf_topn: int | None = 10
    rerank_topn: int = 200

    def of(self, name: str) -> FieldConfig:
        return self.fields.get(name, FieldConfig())


@dataclass(frozen=True)
class ChunkerConfig:
    enable: bool = True
    overlap: int = 10


@dataclass(frozen=True)
class ExpansionConfig:
    threshold: float = 0.01
    cap: int = 2


# Names of the features, in order.
FEATURES = ("bm25_score", "query_len", "query_uniq_len", "title_len", "body_len", "title_overlap_cnt", "body_overlap_cnt", "body_overlap_ratio", "idf_body_overlap_sum", "idf_title_overlap_sum")


@dataclass(frozen=True)
class LtrConfig:
    topn: int = 200
    list_size: int = 100
    hard_pool: int = 50
    seed: int = 42
    hidden: tuple[int, ...] = (512, 256, 128)
    heads: int = 4
    attention: bool = False
    epochs: int = 30
    learning_rate: float = 1e-3
    schedule: str = "cosine"
    temperature: float = 0.1
    #: training: lists at most, share left out for validation, dropout after dense layers, decay of the schedules
    max_lists: int = 20_000
    validation: float = 0.1
    dropout: float = 0.0
    decay_steps: int = 0
    decay_rate: float = 0.96
    alpha: float = 0.0
    best_by: str = "ndcg_10"
    features: tuple[str, ...] = FEATURES
