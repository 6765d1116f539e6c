"""Embedding of distinct texts by pluggable backends."""

from __future__ import annotations

import json
import math
import time
import urllib.request
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.config import Embeddings

Embedder = Callable[[list[str]], list[list[float]]]
#: Attempts at a request, the wait after each in seconds, and the time that a request may take.
ATTEMPTS, WAIT, TIMEOUT = 3, 0.5, 30
#: Words of messages after which another attempt makes sense.
RETRYABLE = ("timeout", "timed out", "429", "500", "502", "503", "504", "connection", "temporarily")
LOCAL_MODEL, LOCAL_BATCH = "nomic-ai/nomic-embed-text-v1.5", 128


class EmbeddingError(RuntimeError):
    pass


def hashing(dimensions: int = 64, sizes: tuple[int, ...] = (3, 4, 5)) -> Embedder:
    """Vectors of hashed character n-grams: the same everywhere, without a model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimensions)
            marked = f" {text.lower()} "
            for n in sizes:
                for k in range(len(marked) - n + 1):
                    h = xxhash.xxh3_64_intdigest(marked[k : k + n])
                    v[h % dimensions] += 1 if h >> 63 else -1
            length = float(np.sqrt(v @ v))
            out.append((v / length if length else v).tolist())
        return out

    return embed


def parse_response(payload: object, size: int) -> list[list[float]]:
    """The vectors of an answer by their ``index``; raises if one is missing or isn't numeric."""
    data = payload.get("data") if isinstance(payload, dict) else None
    if not isinstance(data, list):
        raise EmbeddingError("the answer has no list 'data'")
    found: dict[int, list[float]] = {}
    for x in data:
        if not isinstance(x, dict) or not isinstance(x.get("index"), int) or x["index"] < 0:
            raise EmbeddingError("an entry has no index")
        vector = x.get("embedding")
        if not isinstance(vector, list) or not vector or not all(isinstance(v, int | float) for v in vector):
            raise EmbeddingError("an entry has no numeric embedding")
        found[x["index"]] = [float(v) for v in vector]
    if set(found) != set(range(size)):
        raise EmbeddingError(f"the answer has {len(found)} of {size} vectors")
    return [found[k] for k in range(size)]


def remote(config: Embeddings) -> Embedder:
    def embed(texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {config.api_key}"} if config.api_key else {})
        request = urllib.request.Request(f"{config.base_url}/embeddings", json.dumps({"model": config.model, "input": texts}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                return parse_response(json.loads(answer.read()), len(texts))
        except (OSError, ValueError) as e:
            raise EmbeddingError(str(e)) from e

    return embed


def local(model: str = LOCAL_MODEL) -> Embedder:
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise EmbeddingError("sentence_transformers isn't installed") from e
    held: list = []

    def embed(texts: list[str]) -> list[list[float]]:
        if not held:
            held.append(SentenceTransformer(model, trust_remote_code=True))
        return held[0].encode(texts, batch_size=LOCAL_BATCH).tolist()

    return embed


def persistent(embedder: Embedder, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Try again where that makes sense, then halve the batch; one text that fails fails all."""
    error: Exception | None = None
    for attempt in range(1, ATTEMPTS + 1):
        try:
            found = embedder(texts)
            if len(found) != len(texts):
                raise EmbeddingError(f"{len(found)} vectors for {len(texts)} texts")
            return found
        except Exception as e:  # backends raise what they like
            error = e
            if not any(x in str(e).lower() for x in RETRYABLE):
                break
            if attempt < ATTEMPTS:
                sleep(WAIT * attempt)
    if len(texts) == 1:
        raise EmbeddingError(f"a text can't be embedded: {error}") from error
    half = len(texts) // 2
    return persistent(embedder, texts[:half], sleep) + persistent(embedder, texts[half:], sleep)


def embed_texts(texts: DataFrame, embedder: Embedder, batch_size: int = 512) -> DataFrame:
    """``text`` and ``vector`` for each distinct text of ``texts``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values = b.column(0).to_pylist()
            for k in range(0, len(values), batch_size):
                part = values[k : k + batch_size]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(persistent(embedder, part), pa.list_(pa.float64()))], ["text", "vector"])

    return texts.select("text").where("text is not null").distinct().mapInArrow(run, "text string, vector array<double>")


def with_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Bring vectors back to the rows of their texts."""
    return rows.join(vectors, "text", "left")


def request_count(distinct_texts: int, batch_size: int = 512) -> int:
    return math.ceil(distinct_texts / batch_size)


def distinct_texts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("uses"))
