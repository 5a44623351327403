"""Embedding providers: functions from a list of texts to a list of vectors."""

from __future__ import annotations

import json
import math
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from loomline.config import Transform
from loomline.errors import PipelineError

Provider = Callable[[list[str]], list[list[float]]]


def mock(dimensions: int = 4) -> Provider:
    return lambda texts: [[float(len(t.encode("utf-16-le")) // 2 + i) for i in range(dimensions)] for t in texts]


@dataclass
class HttpProvider:
    """One POST to ``{base_url}/embeddings`` for each batch, with vectors put in order by their index.

    The key is read where the provider is made, on the driver: executors need no environment of their own.
    """

    base_url: str
    model: str
    key: str
    dimensions: int = 0
    timeout_ms: int = 30000

    @classmethod
    def of(cls, t: Transform) -> HttpProvider:
        key = os.environ.get(t.key_env, "")
        if not key.strip():
            raise PipelineError(f"Missing API key environment variable: {t.key_env}")
        return cls(t.base_url, t.model, key, t.dimensions, t.timeout_ms)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        body: dict = {"input": texts, "model": self.model, "encoding_format": "float"}
        if self.dimensions:
            body["dimensions"] = self.dimensions
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/embeddings", json.dumps(body).encode(), headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_ms / 1000) as answer:
                return self.vectors(answer.read().decode(), len(texts))
        except urllib.error.HTTPError as e:
            raise PipelineError(f"Embedding request failed with status {e.code}: {e.read().decode(errors='replace')[:1000]}") from None
        except OSError as e:
            raise PipelineError(f"Embedding request failed: {e}") from None

    @staticmethod
    def vectors(text: str, expected: int) -> list[list[float]]:
        """The vectors of a response. ``index`` places them where every item has one; else their order counts."""
        try:
            items = json.loads(text)["data"]
            assert isinstance(items, list)
        except (ValueError, KeyError, TypeError, AssertionError):
            raise PipelineError("Embedding response did not contain an embedding vector") from None
        if len(items) != expected:
            raise PipelineError(f"Embedding response returned {len(items)} embeddings but expected {expected}")
        placed: dict[int, list[float]] = {}
        for order, item in enumerate(items):
            index = item.get("index", order) if isinstance(item, dict) else order
            values = item.get("embedding") if isinstance(item, dict) else None
            if not isinstance(values, list) or not values:
                raise PipelineError("Embedding response did not contain an embedding vector")
            if not isinstance(index, int) or not 0 <= index < expected:
                raise PipelineError(f"Embedding response index out of range: {index}")
            if index in placed:
                raise PipelineError(f"Embedding response contained duplicate embedding index: {index}")
            for v in values:
                if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
                    raise PipelineError(f"Invalid embedding value: {v}")
            placed[index] = [float(v) for v in values]
        return [placed[i] for i in range(expected)]


#: Makers of providers by name. Further ones are added by :func:`register`.
PROVIDERS: dict[str, Callable[[Transform], Provider]] = {
    "mock": lambda t: mock(t.dimensions),
    "openai-compatible": HttpProvider.of,
}


def register(name: str, make: Callable[[Transform], Provider]) -> None:
    PROVIDERS[name] = make


def create(t: Transform) -> Provider:
    if t.provider not in PROVIDERS:
        raise PipelineError(f"Unsupported embedding provider: {t.provider}")
    return PROVIDERS[t.provider](t)
