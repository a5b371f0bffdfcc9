"""Job parameters. Nothing is read from globals: operators take these as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    initial_results_multiplier: int = 3
    min_confidence: float = 0.7
    rerank_threshold: float = 0.7
    vector_weight: float = 0.7
    rerank_weight: float = 0.3


@dataclass(frozen=True)
class CacheConfig:
    max_size_bytes: int = 500 * 1024 * 1024
    ttl_seconds: int = 3600
    evict_percent: int = 10


@dataclass(frozen=True)
class IngestConfig:
    batch_size: int = 64
    # The suffixes with a handler in this library, by handler name.
    handlers: dict[str, str] = field(
        default_factory=lambda: {
            ".docx": "office",
            ".pptx": "office",
            ".xlsx": "office",
            ".html": "html",
            ".eml": "email",
            ".txt": "text",
        }
    )


@dataclass(frozen=True)
class ComplianceConfig:
    classifications: tuple[str, ...] = ("approved", "restricted")
    access_levels: tuple[str, ...] = ("public", "internal")
