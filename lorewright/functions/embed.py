"""Embedding backends: functions from text columns to vector columns.

A backend is a function of a column, so any of them can be given to the
engine: :func:`stub` draws deterministic vectors, :func:`service` asks an
embedding server, :func:`model` runs a local one, and :func:`backend` picks by
name, ``auto`` being the local model where it loads and the stub where not.
Rows go to the workers in Arrow batches; a model is loaded once a worker.
"""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

VECTOR = T.ArrayType(T.FloatType())
Encoder = Callable[[list[str]], np.ndarray]


def stub_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector drawn from the normal distribution that the text's MD5 seeds."""
    seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big")
    v = np.random.default_rng(seed).standard_normal(dim)
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def stub(dim: int = 384):
    @F.pandas_udf(VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: stub_vector(t or "", dim).tolist())

    return embed


class Encoded:
    """Checks and unit length for the vectors of an encoder, in batches; another dimension than the first is an error."""

    def __init__(self, encode: Encoder, batch: int = 32):
        self.encode, self.batch, self.dim = encode, batch, None

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), self.batch):
            own = texts[a : a + self.batch]
            m = np.asarray(self.encode(own), np.float32)
            m = m.reshape(1, -1) if m.ndim == 1 and len(own) == 1 else m
            self.dim = self.dim or (m.shape[1] if m.ndim == 2 else None)
            if m.ndim != 2 or m.shape != (len(own), self.dim):
                raise ValueError("wrong shape of embeddings")
            n = np.linalg.norm(m, axis=1, keepdims=True)
            out += (m / np.where(n == 0, 1, n)).tolist()
        return out


def model(load: Callable[[], Encoder], batch: int = 32):
    """A backend of an encoder that ``load`` gives, once per worker."""

    @F.pandas_udf(VECTOR)
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = Encoded(load(), batch)
        for texts in parts:
            yield pd.Series(encode([t or "" for t in texts]), dtype=object)

    return embed


def ask(url: str, body: object, headers: dict[str, str] | None = None, timeout: float = 30.0) -> object:
    """The JSON answer to a JSON request."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def service(url: str = "http://localhost:8080", batch: int = 32, timeout: float = 30.0):
    """A backend that posts ``{"inputs": [...]}`` to a text-embeddings server's ``/embed``; anything but a list is an error."""
    address = url.rstrip("/") + "/embed"

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            got = ask(address, {"inputs": texts}, timeout=timeout)
            if not isinstance(got, list):
                raise ValueError(f"not a list of embeddings: {str(got)[:200]}")
            return np.asarray(got, np.float32)

        return encode

    return model(load, batch)


def healthy(url: str, timeout: float = 5.0) -> bool:
    """Whether an embedding server is up."""
    try:
        with urllib.request.urlopen(url.rstrip("/") + "/health", timeout=timeout) as answer:
            return answer.status == 200
    except (OSError, ValueError):
        return False


def backend(kind: str = "auto", *, dim: int = 384, url: str = "http://localhost:8080", load: Callable[[], Encoder] | None = None, batch: int = 32):
    """A backend by name: ``stub``, ``service``, ``local`` (needs ``load``) or ``auto``."""
    if kind == "stub":
        return stub(dim)
    if kind == "service":
        return service(url, batch)
    if kind == "local":
        if load is None:
            raise ValueError("a local model needs a loader")
        return model(load, batch)
    if kind != "auto":
        raise ValueError(f"no backend {kind!r}")
    if load is not None:
        try:
            load()
        except Exception:  # noqa: BLE001 - whatever keeps the model from loading, the stub stands in
            return stub(dim)
        return model(load, batch)
    return stub(dim)


def embed(rows: DataFrame, load: Callable[[], Encoder], id_column: str, text: str, batch: int = 32) -> DataFrame:
    """(id, embedding) by a model or service: ``load`` runs once per worker and gives the function."""
    by: Callable[[Column], Column] = model(load, batch)
    return rows.select(id_column, by(F.col(text)).alias("embedding"))
