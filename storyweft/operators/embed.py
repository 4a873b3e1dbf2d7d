"""Embeddings: a backend protocol, the deterministic backend, and the stage that fills what is missing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.functions.text import embedding_input

#: Texts a request, dimensions, and the bounds of a request's token limit.
BATCH = 32
DIMENSIONS = 4096
MAX_ITEMS = 64
LENGTHS = (8, 4096)


class Backend(Protocol):
    dimensions: int

    def embed(self, texts: list[str], max_length: int) -> list[list[float]]: ...


class HashBackend:
    """Unit vectors from SHA-256 of the text and a counter: equal texts, equal vectors; needs no model."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str], max_length: int = 512) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        need = 2 * self.dimensions
        raw = b"".join(hashlib.sha256(f"{text}\n{i}".encode()).digest() for i in range(-(-need // 32)))[:need]
        v = np.frombuffer(raw, "<u2") / 32767.5 - 1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).tolist()


class NoiseBackend:
    """Unit vectors from a 64-bit xorshift generator (13, 7, 17) seeded by the text's SHA-256, for evaluation runs: equal
    texts have equal vectors, different ones are near-orthogonal. All texts of a call are drawn at once."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str], max_length: int = 512) -> list[list[float]]:
        x = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little") or 1 for t in texts], np.uint64)
        out = np.empty((len(texts), self.dimensions))
        for i in range(self.dimensions):
            x ^= x << np.uint64(13)
            x ^= x >> np.uint64(7)
            x ^= x << np.uint64(17)
            out[:, i] = (x % np.uint64(2_000_001)).astype(np.int64) - 1_000_000
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length > 0, length, 1)).astype(np.float32).tolist()


class RemoteBackend:
    """A service that answers a JSON request of texts. `post` (url, body) -> answer does the transport, so any client or
    stand-in serves. Answers are {embeddings: [...]} in order, or {data: [{index, embedding}]} put in order of index."""

    def __init__(self, url: str, post: Callable[[str, dict], dict], dimensions: int = DIMENSIONS):
        self.url, self.post, self.dimensions = url.rstrip("/"), post, dimensions
        self.listed = self.url.endswith("/embeddings")  # services of the second kind

    def embed(self, texts: list[str], max_length: int = 512) -> list[list[float]]:
        answer = self.post(self.url, {"input": texts} if self.listed else {"texts": texts, "max_length": max_length})
        if "data" in answer:
            by = {int(x["index"]): x["embedding"] for x in answer["data"]}
            if sorted(by) != list(range(len(texts))) or len(answer["data"]) != len(texts):
                raise ValueError("the service's answers don't match the texts asked for")
            vectors = [by[i] for i in range(len(texts))]
        else:
            vectors = answer.get("embeddings", [])
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors


def health(backend: Backend) -> dict:
    """Whether a backend answers, and with vectors of its dimensions."""
    try:
        v = backend.embed(["health"], LENGTHS[0])
        ok = len(v) == 1 and len(v[0]) == backend.dimensions and bool(np.isfinite(v[0]).all())
        return {"ok": ok, "dimensions": len(v[0]) if v else 0, "error": None}
    except Exception as e:  # a health check tells of failures, whatever they are
        return {"ok": False, "dimensions": 0, "error": str(e)}


BACKENDS: dict[str, Callable[[], Backend]] = {"hash": HashBackend, "noise": NoiseBackend}


def request(texts, max_length: int = 512) -> tuple[list[str], int]:
    """A request's texts (one or a list; blanks dropped, 64 at most) and its limit within bounds."""
    own = [texts] if isinstance(texts, str) else list(texts)
    own = [t for t in own if isinstance(t, str) and t.strip()]
    if not own:
        raise ValueError("no text to embed")
    if len(own) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} texts")
    return own, min(max(int(max_length), LENGTHS[0]), LENGTHS[1])


def pending(articles: DataFrame, embeddings: DataFrame, model: str, version: str) -> DataFrame:
    """Articles without an embedding of that model and version."""
    have = embeddings.filter((F.col("model_name") == model) & (F.col("model_version") == version)).select("article_id")
    return articles.join(have, "article_id", "left_anti")


def embed(articles: DataFrame, make: Callable[[], Backend], model: str, version: str, max_length: int = 512) -> DataFrame:
    """article_id, model_name, model_version, embedding; a backend is made once a task and called for BATCH texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for frame in batches:
            for i in range(0, len(frame), BATCH):
                own = frame.iloc[i : i + BATCH]
                vectors = backend.embed(own["input"].tolist(), max_length)
                if len(vectors) != len(own) or any(len(v) != backend.dimensions or not np.isfinite(v).all() for v in vectors):
                    raise ValueError("the backend returned other vectors than were asked for")
                yield pd.DataFrame({"article_id": own["article_id"], "model_name": model, "model_version": version, "embedding": vectors})

    rows = articles.select("article_id", embedding_input(F.col("title"), F.col("body")).alias("input")).filter("input <> ''")
    return rows.mapInPandas(run, "article_id long, model_name string, model_version string, embedding array<float>")
