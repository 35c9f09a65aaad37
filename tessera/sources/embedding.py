"""Embedders: texts to dense vectors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F

#: Fixed value: the text that is embedded to learn a model's dimension.
PROBE = "dimension test"


class EmbedError(RuntimeError):
    pass


class Embedder(Protocol):
    def embed(self, model: str, texts: Sequence[str]) -> list[list[float]]: ...


@lru_cache(100_000)
def _word_hash(model: str, word: str) -> int:
    return int.from_bytes(blake2b(f"{model}:{word}".encode(), digest_size=8).digest(), "big")


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic vectors from hashed words, for tests and where no service is at hand."""

    dim: int = 64

    def embed(self, model: str, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in text.lower().split():
                h = _word_hash(model, word)
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


@dataclass(frozen=True)
class HttpEmbedder:
    """A service that answers {"model", "input"} with {"data": [{"embedding", "index"}]}.

    Answers come in any order and are put in that of the texts. Gateway errors and failed connections are tried again, after
    ``backoff`` times 1, 2, 4, ... seconds; timeouts and other errors are not.
    """

    url: str
    timeout: float = 600
    retries: int = 3
    backoff: float = 0.5

    def _post(self, body: bytes) -> dict:
        request = urllib.request.Request(f"{self.url.rstrip('/')}/v1/embeddings", body, {"Content-Type": "application/json"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in (502, 503, 504) or attempt == self.retries:
                    raise EmbedError(f"the embedder answered {e.code}") from e
            except TimeoutError as e:
                raise EmbedError("the embedder timed out") from e
            except urllib.error.URLError as e:
                if isinstance(e.reason, TimeoutError) or attempt == self.retries:
                    raise EmbedError(f"the embedder can't be reached: {e.reason}") from e
            time.sleep(self.backoff * 2**attempt)
        raise AssertionError

    def available(self, model: str | None = None) -> bool:
        """Whether the service answers; with a model, whether it is in the service's list."""
        try:
            with urllib.request.urlopen(f"{self.url.rstrip('/')}/v1/models", timeout=10) as answer:
                listed = json.load(answer).get("data", [])
        except (OSError, ValueError):
            return False
        return model is None or any(m.get("id") == model for m in listed)

    def embed(self, model: str, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        answer = self._post(json.dumps({"model": model, "input": list(texts)}).encode())
        if "data" not in answer:
            raise EmbedError("the embedder's answer has no data")
        data = answer["data"]
        if len(data) != len(texts):
            raise EmbedError(f"{len(texts)} texts, {len(data)} vectors")
        return [d["embedding"] for _, d in sorted(((d.get("index", i), d) for i, d in enumerate(data)), key=lambda x: x[0])]


def dimension(embedder: Embedder, model: str) -> int:
    return len(embedder.embed(model, [PROBE])[0])


def embed_udf(embedder: Embedder, model: str, batch: int = 16):
    """A UDF text -> (vector, error) that calls the embedder for ``batch`` texts at a time. Where a call fails, its texts have the error, and the others go on."""

    @F.pandas_udf("struct<vector:array<float>,error:string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            values, rows = t.fillna("").tolist(), []
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                try:
                    rows += [(v, None) for v in embedder.embed(model, part)]
                except Exception as e:  # noqa: BLE001  any fault of the embedder is that of these texts
                    rows += [(None, str(e) or type(e).__name__)] * len(part)
            yield pd.DataFrame(rows, columns=["vector", "error"], dtype=object)

    return run
