"""Pluggable models behind vectorised functions, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(size: int = 64) -> Embedder:
    """Signed hashed bags of words of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def embedding(make: Callable[[], Embedder], batch: int = 32):
    """A column function text -> array<float>. `make` loads the model once in each worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            t = s.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(t), batch) for v in model(t[k : k + batch])])

    return run


def scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], chars: int = 1000):
    """A column function (query, content) -> double, as a cross-encoder's; contents are cut to `chars`."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, c in parts:
            yield pd.Series(model([(a or "", (b or "")[:chars]) for a, b in zip(q, c, strict=True)]))

    return run


def overlap_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """Share of the query's words that the content has."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, c in pairs:
            a, b = set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", c.lower()))
            out.append(len(a & b) / len(a) if a else 0.0)
        return out

    return score


def reranked(rows, query: Column, content: Column, model=None):
    """Rows with their score replaced by the reranker's; first_stage_score keeps the old one."""
    run = model or scorer(overlap_scorer)
    return rows.withColumn("first_stage_score", F.col("score")).withColumn("score", run(query, content))
