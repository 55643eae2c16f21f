"""Embedding and chat providers: protocols, HTTP adapters, deterministic stand-ins, and Arrow wrappers."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import portions
from ..plans.workspace import Store, small_batches

EMBED_BATCH = 32
CONTEXT_TOKENS = 8192
# the family's instruction for queries, and the names of embedding policies: fixed values
QWEN3_QUERY = "Instruct: Given a CTF search query, retrieve relevant writeup passages that answer the query\nQuery: "
QWEN3_POLICY, NO_POLICY = "qwen3-instruct-v1", "none"


class ProviderError(RuntimeError):
    """A service that cannot be reached, or whose answer makes no sense."""


@dataclass(frozen=True)
class EmbedderConfig:
    model_id: str
    endpoint: str = "http://localhost:11434"
    timeout_seconds: int = 180


@dataclass(frozen=True)
class GeneratorConfig:
    model_id: str
    endpoint: str = "http://localhost:11434"
    timeout_seconds: int = 300
    temperature: float = 0.2
    max_output_tokens: int = 512


@dataclass(frozen=True)
class Message:
    role: str  # system, user or assistant
    text: str


class Embedder(Protocol):
    model_id: str
    policy: str

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class Generator(Protocol):
    model_id: str

    def chat(self, messages: list[Message]) -> str: ...


def checked_vectors(raw: object, n: int) -> list[list[float]]:
    """n vectors at unit length; raises unless they are non-empty, numeric, finite, non-zero and of one dimension."""
    if not isinstance(raw, list) or len(raw) != n:
        raise ProviderError("the embedding service gave another number of vectors")
    out: list[list[float]] = []
    for v in raw:
        if not isinstance(v, list) or not v or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in v):
            raise ProviderError("the embedding service gave a vector that is empty or not finite")
        if out and len(v) != len(out[0]):
            raise ProviderError("the embedding service gave vectors of several dimensions")
        a = np.asarray(v, float)
        size = math.sqrt(float((a * a).sum()))
        if size == 0:
            raise ProviderError("the embedding service gave a zero vector")
        out.append((a / size).astype(np.float32).tolist())
    return out


def post(endpoint: str, path: str, body: dict, timeout: int, what: str) -> object:
    request = urllib.request.Request(endpoint.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            status, raw = response.status, response.read()
    except urllib.error.HTTPError as e:
        raise ProviderError(f"the {what} service answered {e.code}: {e.read()[:200].decode('utf-8', 'replace')}") from e
    except OSError as e:
        raise ProviderError(f"the {what} service at {endpoint} cannot be reached: {e}") from e
    if status != 200:
        raise ProviderError(f"the {what} service answered {status}")
    try:
        return json.loads(raw)
    except ValueError as e:
        raise ProviderError(f"the {what} service's answer is no JSON") from e


class _HttpEmbedder:
    def __init__(self, config: EmbedderConfig):
        if not config.model_id or not config.endpoint or config.timeout_seconds <= 0:
            raise ValueError("an embedder needs a model, an endpoint and a positive timeout")
        self.config, self.model_id = config, config.model_id
        self.policy = QWEN3_POLICY if config.model_id.startswith("qwen3") else NO_POLICY

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return checked_vectors(self._request(texts), len(texts)) if texts else []

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([QWEN3_QUERY + text if self.policy == QWEN3_POLICY else text])[0]

    def _request(self, texts: list[str]) -> object:
        raise NotImplementedError


class OllamaEmbedder(_HttpEmbedder):
    def _request(self, texts: list[str]) -> object:
        answer = post(self.config.endpoint, "/api/embed", {"model": self.model_id, "input": texts}, self.config.timeout_seconds, "embedding")
        return answer.get("embeddings") if isinstance(answer, dict) else None


class LlamaCppEmbedder(_HttpEmbedder):
    def _request(self, texts: list[str]) -> object:
        answer = post(self.config.endpoint, "/v1/embeddings", {"model": self.model_id, "input": texts}, self.config.timeout_seconds, "embedding")
        rows = answer.get("data") if isinstance(answer, dict) else None
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            return None
        if all(isinstance(r.get("index"), int) for r in rows):
            rows = sorted(rows, key=lambda r: r["index"])
        return [r.get("embedding") for r in rows]


class _HttpGenerator:
    def __init__(self, config: GeneratorConfig):
        if not config.model_id or not config.endpoint or config.timeout_seconds <= 0 or config.max_output_tokens <= 0:
            raise ValueError("a generator needs a model, an endpoint, a positive timeout and room for an answer")
        self.config, self.model_id = config, config.model_id

    def chat(self, messages: list[Message]) -> str:
        if not messages:
            raise ProviderError("a chat needs a message")
        answer = self._request([{"role": m.role, "content": m.text} for m in messages])
        if not isinstance(answer, str):
            raise ProviderError("the chat service's answer has no message")
        return answer


class OllamaGenerator(_HttpGenerator):
    def _request(self, messages: list[dict]) -> object:
        options = {"temperature": self.config.temperature, "num_predict": self.config.max_output_tokens, "num_ctx": CONTEXT_TOKENS}
        answer = post(self.config.endpoint, "/api/chat", {"model": self.model_id, "messages": messages, "stream": False, "think": False, "options": options}, self.config.timeout_seconds, "chat")
        message = answer.get("message") if isinstance(answer, dict) else None
        return message.get("content") if isinstance(message, dict) else None


class LlamaCppGenerator(_HttpGenerator):
    def _request(self, messages: list[dict]) -> object:
        body = {"model": self.model_id, "messages": messages, "stream": False, "temperature": self.config.temperature, "max_tokens": self.config.max_output_tokens}
        answer = post(self.config.endpoint, "/v1/chat/completions", body, self.config.timeout_seconds, "chat")
        choices = answer.get("choices") if isinstance(answer, dict) else None
        message = choices[0].get("message") if isinstance(choices, list) and choices and isinstance(choices[0], dict) else None
        return message.get("content") if isinstance(message, dict) else None


class HashEmbedder:
    """Offline stand-in: a unit vector of hashed words, the same for the same text."""

    def __init__(self, dimension: int = 32, model_id: str = "hash"):
        self.dimension, self.model_id, self.policy = dimension, model_id, NO_POLICY

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [1e-3] * self.dimension
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                v[h[0] % self.dimension] += 1.0 if h[1] & 1 else -1.0
            out.append(v)
        return checked_vectors(out, len(texts)) if texts else []

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


class EchoGenerator:
    """Offline stand-in: a fixed answer, and what it was asked last. A task asks one generator all its prompts, so no more are kept."""

    def __init__(self, answer: str = "See [1].", model_id: str = "echo"):
        self.answer, self.model_id, self.asked = answer, model_id, deque(maxlen=1)

    def chat(self, messages: list[Message]) -> str:
        if not messages:
            raise ProviderError("a chat needs a message")
        self.asked.append(list(messages))
        return self.answer


EMBEDDERS: dict[str, Callable] = {"ollama": OllamaEmbedder, "llama.cpp": LlamaCppEmbedder, "hash": lambda config: HashEmbedder(model_id=config.model_id)}
GENERATORS: dict[str, Callable] = {"ollama": OllamaGenerator, "llama.cpp": LlamaCppGenerator, "echo": lambda config: EchoGenerator(model_id=config.model_id)}


def embed_texts(rows: DataFrame, factory: Callable[[], Embedder], text_col: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """rows with embedding array<float>; each task makes its own provider and sends `batch` texts a request, in order."""
    names = [c for c in rows.columns if c != "embedding"]
    keep, at = rows.select(*names), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [v for i in range(0, len(texts), batch) for v in provider.embed_documents(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float32()))], names=[*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    return keep.mapInArrow(run, f"{schema}, embedding array<float>")


_MADE = "_key string, embedding array<float>, error string"


def embed_resumable(rows: DataFrame, factory: Callable[[], Embedder], store: str, text_col: str = "text", batch: int = EMBED_BATCH, retries: int = 3, wait: float = 0.5) -> DataFrame:
    """rows with embedding array<float> and error, from a store that later calls go on with.

    The store, a folder, has a vector for each text that was embedded with this model and policy; only texts without one are sent, each
    once however often it stands in rows. A request that fails is sent again, after waits that double; if it never succeeds, its texts have
    the error and no vector, and all others keep theirs. A null text counts as the empty one.
    """
    spark = rows.sparkSession
    own = factory()
    keyed = rows.drop("embedding", "error").withColumn("_key", F.sha2(F.concat_ws("\0", F.lit(own.model_id), F.lit(own.policy), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    folder = Store(spark, store)

    def made() -> DataFrame:
        return spark.read.schema(_MADE + ", attempt string").option("basePath", folder.root).parquet(folder.root) if folder.exists("") else spark.createDataFrame([], _MADE + ", attempt string")

    known = made().where("error is null").select("_key")
    todo = keyed.select("_key", F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["_key"]).join(known, "_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column(1).to_pylist()
                found, error = [None] * len(texts), None
                for turn in range(retries):
                    try:
                        found, error = provider.embed_documents(texts), None
                        break
                    except ProviderError as e:
                        error = str(e)
                        if turn + 1 < retries:
                            time.sleep(wait * 2**turn)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32())), pa.array([error] * len(texts), pa.string())], names=["_key", "embedding", "error"])

    attempt = uuid.uuid4().hex
    todo.mapInArrow(run, _MADE).write.parquet(f"{folder.root}/attempt={attempt}")
    good = made().where((F.col("error").isNull()) | (F.col("attempt") == attempt)).groupBy("_key").agg(F.max_by("embedding", F.col("error").isNull()).alias("embedding"), F.max_by("error", F.col("error").isNull()).alias("error"))
    return keyed.join(good, "_key", "left").drop("_key")


def embed_queries(queries: DataFrame, factory: Callable[[], Embedder]) -> DataFrame:
    """(qid, embedding) of queries (qid, text); the provider adds what its model wants before a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([provider.embed_query(t) for t in b.column(1).to_pylist()], pa.list_(pa.float32()))], names=["qid", "embedding"])

    return queries.select(F.col("qid").cast("long"), "text").mapInArrow(run, "qid long, embedding array<float>")


def generate(prompts: DataFrame, factory: Callable[[], Generator]) -> DataFrame:
    """(qid, answer, error) of prompts (qid, system, user): a failed call gives its message and no answer. A worker holds one prompt as text, or as many as stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            for part in portions(b, 2):
                answers, errors = [], []
                for system, user in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    try:
                        answers.append(provider.chat([Message("system", system), Message("user", user)]))
                        errors.append(None)
                    except ProviderError as e:
                        answers.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["qid", "answer", "error"])

    small_batches(prompts.sparkSession)
    return prompts.select(F.col("qid").cast("long"), "system", "user").mapInArrow(run, "qid long, answer string, error string")
