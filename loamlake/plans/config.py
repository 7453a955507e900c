"""Settings of retrieval, evidence and answers, with their environment names and clamps."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any, Self
from urllib.parse import unquote, urlsplit

TOP_K, LEAST_K, MOST_K = 5, 1, 20


def _flag(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class _FromEnv:
    @classmethod
    def environment(cls) -> dict[str, tuple[str, Callable[[str], Any]]]:
        raise NotImplementedError

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Self:
        env, names = os.environ if env is None else env, cls.environment()
        return cls(**{f.name: names[f.name][1](env[names[f.name][0]]) for f in fields(cls) if f.name in names and names[f.name][0] in env})


_at_least = lambda low, kind: lambda v: max(low, kind(v))
_share = lambda v: min(1.0, max(0.0, float(v)))


@dataclass(frozen=True)
class RetrievalConfig(_FromEnv):
    hybrid_enabled: bool = True
    lexical_enabled: bool = True
    initial_candidates: int = 20
    final_sources: int = 5
    max_chunks_per_source: int = 1
    vector_weight: float = 1.0
    lexical_weight: float = 2.0
    rrf_k: float = 60.0
    title_weight: float = 3.0
    category_weight: float = 1.5
    content_weight: float = 1.0
    author_weight: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    stopwords: str = "shipped"

    @classmethod
    def environment(cls) -> dict[str, tuple[str, Callable[[str], Any]]]:
        return {
            "hybrid_enabled": ("RAG_HYBRID_ENABLED", _flag),
            "lexical_enabled": ("RAG_LEXICAL_ENABLED", _flag),
            "initial_candidates": ("RAG_INITIAL_CANDIDATES", _at_least(1, int)),
            "final_sources": ("RAG_FINAL_SOURCES", _at_least(1, int)),
            "max_chunks_per_source": ("RAG_MAX_CHUNKS_PER_SOURCE", _at_least(1, int)),
            "vector_weight": ("RAG_VECTOR_WEIGHT", float),
            "lexical_weight": ("RAG_LEXICAL_WEIGHT", float),
            "rrf_k": ("RAG_RRF_K", _at_least(1.0, float)),
            "title_weight": ("RAG_LEXICAL_TITLE_WEIGHT", float),
            "category_weight": ("RAG_LEXICAL_CATEGORY_WEIGHT", float),
            "content_weight": ("RAG_LEXICAL_CONTENT_WEIGHT", float),
            "author_weight": ("RAG_LEXICAL_AUTHOR_WEIGHT", float),
            "bm25_k1": ("RAG_BM25_K1", _at_least(0.01, float)),
            "bm25_b": ("RAG_BM25_B", _share),
        }

    @property
    def field_weights(self) -> dict[str, float]:
        return {"titulo": self.title_weight, "categoria": self.category_weight, "texto": self.content_weight, "autor": self.author_weight}


@dataclass(frozen=True)
class EvidenceConfig(_FromEnv):
    enabled: bool = True
    min_direct_sources: int = 1
    min_total_relevant_sources: int = 2
    min_query_term_coverage: float = 0.60
    min_lexical_matched_sources: int = 1
    allow_single_strong_source: bool = True
    single_min_coverage: float = 0.80
    single_require_title_match: bool = False
    single_min_matched_terms: int = 2
    single_max_lexical_rank: int = 3
    single_allow_strong_partial: bool = True
    reject_all_weak: bool = True

    @classmethod
    def environment(cls) -> dict[str, tuple[str, Callable[[str], Any]]]:
        return {
            "enabled": ("RAG_EVIDENCE_CHECK_ENABLED", _flag),
            "min_direct_sources": ("RAG_MIN_DIRECT_SOURCES", _at_least(0, int)),
            "min_total_relevant_sources": ("RAG_MIN_TOTAL_RELEVANT_SOURCES", _at_least(1, int)),
            "min_query_term_coverage": ("RAG_MIN_QUERY_TERM_COVERAGE", _share),
            "min_lexical_matched_sources": ("RAG_MIN_LEXICAL_MATCHED_SOURCES", _at_least(0, int)),
            "allow_single_strong_source": ("RAG_ALLOW_SINGLE_STRONG_SOURCE", _flag),
            "single_min_coverage": ("RAG_SINGLE_STRONG_SOURCE_MIN_COVERAGE", _share),
            "single_require_title_match": ("RAG_SINGLE_STRONG_SOURCE_REQUIRE_TITLE_MATCH", _flag),
            "single_min_matched_terms": ("RAG_SINGLE_STRONG_SOURCE_MIN_MATCHED_TERMS", _at_least(2, int)),
            "single_max_lexical_rank": ("RAG_SINGLE_STRONG_SOURCE_MAX_LEXICAL_RANK", _at_least(1, int)),
            "single_allow_strong_partial": ("RAG_SINGLE_STRONG_SOURCE_ALLOW_STRONG_PARTIAL", _flag),
            "reject_all_weak": ("RAG_REJECT_ALL_WEAK", _flag),
        }


@dataclass(frozen=True)
class AnswerConfig:
    max_context_chars: int = 6000
    max_sources: int = 3
    temperature: float = 0.1
    num_predict: int = 96
    num_ctx: int = 2048

    def __post_init__(self) -> None:
        if min(self.max_context_chars, self.max_sources, self.num_predict, self.num_ctx) < 1:
            raise ValueError("limits must be positive")


def valid_top_k(top_k: int) -> int:
    if isinstance(top_k, bool) or not isinstance(top_k, int):
        raise TypeError("top_k must be an integer")
    if not LEAST_K <= top_k <= MOST_K:
        raise ValueError(f"top_k must lie between {LEAST_K} and {MOST_K}")
    return top_k


def valid_mode(mode: str) -> str:
    if mode not in ("vector", "lexical", "hybrid"):
        raise ValueError("mode must be vector, lexical or hybrid")
    return mode


def jdbc_options(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for a text table that lives in PostgreSQL: DATABASE_URL, else host, port, name, user and password."""
    env = os.environ if env is None else env
    if dsn := env.get("DATABASE_URL", ""):
        parts = urlsplit(dsn)
        host, port, name, user, password = parts.hostname or "localhost", parts.port or 5432, parts.path.lstrip("/"), unquote(parts.username or ""), unquote(parts.password or "")
    else:
        get = lambda k, default="": env.get(f"POSTGRES_{k}", default)
        host, port, name, user, password = get("HOST", "localhost"), get("PORT", "5432"), get("DB"), get("USER"), get("PASSWORD")
    if not name:
        raise ValueError("no database is named")
    return {"url": f"jdbc:postgresql://{host}:{port}/{name}", "user": user, "password": password, "driver": "org.postgresql.Driver"}
