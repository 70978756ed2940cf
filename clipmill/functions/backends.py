"""Language-model backends, called in batches from executors."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMEOUT = 600


class Backend(Protocol):
    def generate(self, prompt: str, model: str) -> str: ...
    def embed(self, text: str, model: str) -> list[float]: ...


@dataclass(frozen=True)
class Offline:
    """Answers that depend on nothing but the prompt; the default, and what tests use."""

    width: int = 16

    def generate(self, prompt: str, model: str) -> str:
        lines = [x.strip() for x in prompt.split("\n") if x.strip()]
        return "\n".join(f"- {x[:200]}" for x in lines[1:4])

    def embed(self, text: str, model: str) -> list[float]:
        vector = [0.0] * self.width
        for word in text.lower().split():
            digest = hashlib.sha256(word.encode()).digest()
            vector[digest[0] % self.width] += 1.0 if digest[1] % 2 else -1.0
        return vector


def post(url: str, body: dict, headers: dict[str, str] | None = None, form: bool = False) -> dict:
    data = urllib.parse.urlencode(body).encode() if form else json.dumps(body).encode()
    kind = "application/x-www-form-urlencoded" if form else "application/json"
    request = urllib.request.Request(url, data, {"Content-Type": kind, **(headers or {})})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class LocalServer:
    """A model server with /api/generate and /api/embeddings."""

    url: str = "http://localhost:11434"

    def generate(self, prompt: str, model: str) -> str:
        return post(f"{self.url}/api/generate", {"model": model, "prompt": prompt, "stream": False})["response"]

    def embed(self, text: str, model: str) -> list[float]:
        return post(f"{self.url}/api/embeddings", {"model": model, "prompt": text})["embedding"]


@dataclass
class ChatServer:
    """An endpoint of the usual chat-completions form, with a key or client credentials (renewed a minute early)."""

    url: str
    key: str | None = None
    token_url: str | None = None
    client_id: str | None = None
    client_secret: str | None = None
    _token: tuple[str, float] = field(default=("", 0.0), repr=False)

    def _headers(self) -> dict[str, str]:
        if self.key:
            return {"Authorization": f"Bearer {self.key}"}
        if not self.token_url:
            return {}
        if time.time() > self._token[1] - 60:
            found = post(self.token_url, {"grant_type": "client_credentials", "client_id": self.client_id, "client_secret": self.client_secret}, form=True)
            self._token = (found["access_token"], time.time() + float(found.get("expires_in", 3600)))
        return {"Authorization": f"Bearer {self._token[0]}"}

    def generate(self, prompt: str, model: str) -> str:
        found = post(f"{self.url}/chat/completions", {"model": model, "messages": [{"role": "user", "content": prompt}]}, self._headers())
        return found["choices"][0]["message"]["content"]

    def embed(self, text: str, model: str) -> list[float]:
        return post(f"{self.url}/embeddings", {"model": model, "input": text}, self._headers())["data"][0]["embedding"]


def answers(df: DataFrame, prompt: Column, backend: Backend, model: str) -> DataFrame:
    """``df`` with ``answer`` and ``error``: a prompt that fails has an error and the others go on."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows = []
            for p in prompts:
                try:
                    rows.append((backend.generate(p or "", model), None))
                except Exception as e:  # one bad answer must not stop a worklist
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return df.withColumn("__a", ask(prompt)).select("*", "__a.answer", "__a.error").drop("__a")


def embeddings(df: DataFrame, text: str, backend: Backend, model: str) -> DataFrame:
    """``df`` with ``embedding``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([backend.embed(t or "", model) for t in texts])

    return df.withColumn("embedding", embed(F.col(text)))
