"""Embedders behind one protocol; the default hashes words, needs no network, and is the same everywhere."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    model_id: str
    dim: int
    max_chars: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of words and word pairs in `dim` places, scaled to length 1."""

    def __init__(self, dim: int = 384, max_chars: int = 16384) -> None:
        self.model_id, self.dim, self.max_chars = f"hashing-{dim}", dim, max_chars

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", t[: self.max_chars].lower())
            for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(w.encode("utf-8", "replace"))
                out[i, (h >> 1) % self.dim] += 1 if h & 1 else -1
        norm = np.sqrt(np.square(out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Vectors of texts from those of their tokens (texts x tokens x dim): the mean over the tokens that the mask has, scaled to length 1."""
    m = mask[..., None].astype(np.float64)
    mean = (tokens * m).sum(1) / np.maximum(m.sum(1), 1)
    norm = np.sqrt(np.square(mean).sum(1, keepdims=True))
    return mean / np.where(norm > 0, norm, 1)


def probe(embedder: Embedder, text: str = "dimension") -> int:
    """How long an embedder's vectors are, found by asking it."""
    return int(np.asarray(embedder.embed([text])).shape[1])


class HttpEmbedder:
    """Vectors from a server that speaks JSON, as local model servers and hosted ones do: POST {"model", "input": [texts]}.

    The reply's vectors are either a list `embeddings` in order, or rows `data` of (index, embedding), which may come in any order."""

    def __init__(self, url: str, model: str, dim: int = 0, max_chars: int = 16384, key: str = "", timeout: float = 30.0) -> None:
        self.url, self.model_id, self.max_chars, self.key, self.timeout = url, model, max_chars, key, timeout
        self.dim = dim
        self.dim = dim or probe(self)

    def embed(self, texts: list[str]) -> np.ndarray:
        import json
        import urllib.request

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        asked = urllib.request.Request(self.url, json.dumps({"model": self.model_id, "input": texts}).encode(), headers)
        with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
            got = json.load(reply)
        if "data" in got:
            rows = sorted(got["data"], key=lambda r: r["index"])
            if [r["index"] for r in rows] != list(range(len(texts))):
                raise ValueError("the reply does not have a vector for each text")
            vectors = [r["embedding"] for r in rows]
        else:
            vectors = got["embeddings"]
        if len(vectors) != len(texts) or any(self.dim and len(v) != self.dim for v in vectors):
            raise ValueError("the reply has other vectors than were asked for")
        return np.array(vectors, np.float64)


def embedded_or_none(embedder: Embedder | None, text: str, seconds: float = 3.0) -> list[float] | None:
    """A query's vector, or None where there is no embedder, or it fails or takes longer: then a recall is lexical alone."""
    from concurrent.futures import ThreadPoolExecutor

    if embedder is None:
        return None
    pool = ThreadPoolExecutor(1)
    try:
        return [float(x) for x in pool.submit(embedder.embed, [text]).result(seconds)[0]]
    except Exception:
        return None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
