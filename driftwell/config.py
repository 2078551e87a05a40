"""Settings that are part of the meaning of a query; always passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class SearchConfig:
    """Retrieval, fusion and ranking parameters."""

    rrf_k: int = 60
    note_count_boost: float = 0.1
    half_life_days: float = 90.0
    analyser: str = "english"
    keyword_depth: int = 100
    vector_depth: int = 100
    account_depth: int = 50
    tag_depth: int = 30
    prefix_depth: int = 20
    account_window: int = 100
    rollup_depth: int = 200
    weight_text: float = 0.5
    weight_image: float = 0.35
    weight_tag: float = 0.15
    nsfw_threshold: float = 0.75
    similarity_threshold: float = 0.3
    snippet_length: int = 120
    target_post_count: int = 50_000
    cache_ttl_seconds: int = 300
    chunk_size: int = 512
    chunk_overlap: int = 64
    cursor_tolerance: float = 1e-9


@dataclass(frozen=True)
class Filters:
    """Optional conditions of a search; None means no condition."""

    lang: str | None = None
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None
    min_notes: int | None = None
    tags: tuple[str, ...] = field(default_factory=tuple)


def check_query(query: str, most: int = 500) -> str:
    """The stripped query; ValueError unless it has 1 to ``most`` characters."""
    q = (query or "").strip()
    if not 1 <= len(q) <= most:
        raise ValueError(f"a query has 1 to {most} characters")
    return q


def check_limit(value: int, least: int, most: int, name: str) -> int:
    """``value``; ValueError outside [least, most]."""
    if not least <= value <= most:
        raise ValueError(f"{name} must lie in {least} to {most}")
    return value
