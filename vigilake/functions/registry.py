"""Providers by name: text embeddings and rule knowledge."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cache
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.ids import hash_embedding


@dataclass(frozen=True)
class EmbeddingIdentity:
    """What makes vectors comparable."""

    backend: str = "mock"
    model: str = "mock-embedding"
    dimensions: int = 64

    def digest(self) -> str:
        return sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


_EMBEDDINGS: dict[str, Callable[[EmbeddingIdentity], Callable[[Column], Column]]] = {}
_KNOWLEDGE: dict[str, Callable[[DataFrame, int], DataFrame]] = {}


def embedding_backend(name: str):
    """Register a maker of column functions under a backend's name."""

    def keep(make):
        _EMBEDDINGS[name] = make
        return make

    return keep


@cache
def embedder(identity: EmbeddingIdentity) -> Callable[[Column], Column]:
    """The backend's column function, made once for each identity. Unknown backends are an error."""
    if identity.backend not in _EMBEDDINGS:
        raise ValueError(f"no embedding backend {identity.backend!r}; known: {', '.join(sorted(_EMBEDDINGS))}")
    return _EMBEDDINGS[identity.backend](identity)


@embedding_backend("mock")
def _hashed(identity: EmbeddingIdentity) -> Callable[[Column], Column]:
    return lambda text: hash_embedding(text, identity.dimensions)


def knowledge_backend(name: str):
    def keep(make):
        _KNOWLEDGE[name] = make
        return make

    return keep


def retrieve_rules(questions: DataFrame, top_k: int = 5, backend: str = "mock") -> DataFrame:
    """(question_id, chunk_id, title, text, score) that a knowledge backend finds for questions (question_id, question)."""
    if backend not in _KNOWLEDGE:
        raise ValueError(f"no knowledge backend {backend!r}; known: {', '.join(sorted(_KNOWLEDGE))}")
    return _KNOWLEDGE[backend](questions, top_k)


@knowledge_backend("mock")
def _one_chunk(questions: DataFrame, top_k: int) -> DataFrame:
    return questions.select("question_id", F.lit("mock-0").alias("chunk_id"), F.lit("mock rule").alias("title"), F.col("question").alias("text"), F.lit(1.0).alias("score"))
