"""Seams to models outside: protocols, an offline embedder, a rate limiter and retries."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class TextClient(Protocol):
    def __call__(self, prompt: str) -> str: ...


class EmbeddingClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Offline embedder: signed hashed word counts of unit length. The same text gives the same vector everywhere."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def embed_column(c: Column, client: EmbeddingClient, batch: int = 100) -> Column:
    """Vectors of a text column, in calls of ``batch`` texts."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in client.embed(texts[i : i + batch])], index=s.index)

    return run(c)


class TokenBucket:
    """At most ``rate`` calls a second in the long run, ``burst`` at once."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def take(self, n: float = 1) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        self.tokens -= n
        if self.tokens < 0:
            self.sleep(-self.tokens / self.rate)


def with_retries(call: Callable[[], object], attempts: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep, retry_after: Callable[[Exception], float | None] = lambda e: None):
    """Result of ``call``; failures are repeated after exponential pauses with jitter, or after the time the error names."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001 - the caller decides by attempts
            if k + 1 == attempts:
                raise
            wait = retry_after(e)
            sleep(wait if wait is not None else base * 2**k * (0.5 + random.random() / 2))
