"""Language-model and embedding connectors behind one interface each; both have deterministic stand-ins."""

from __future__ import annotations

import functools
import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ANSWER = "answer string, error string, seconds double, tokens_in long, tokens_out long"


@dataclass
class Answer:
    text: str | None = None
    error: str | None = None
    seconds: float = 0.0
    tokens_in: int = 0
    tokens_out: int = 0


def _post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 600) -> dict:
    req = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
    with urllib.request.urlopen(req, timeout=timeout) as r:
        return json.loads(r.read())


@dataclass
class LocalServer:
    """A model server on a local port that answers whole responses; ``as_json`` asks for JSON."""

    model: str
    url: str = "http://localhost:11434/api/generate"
    as_json: bool = False

    def __call__(self, prompt: str) -> Answer:
        body = {"model": self.model, "prompt": prompt, "stream": False} | ({"format": "json"} if self.as_json else {})
        r = _post(self.url, body)
        return Answer((r.get("response") or "").strip(), None, r.get("total_duration", 0) / 1e9, r.get("prompt_eval_count", 0), r.get("eval_count", 0))


@dataclass
class HostedMessages:
    """A hosted model with a messages interface: the first text block of the answer."""

    model: str
    url: str
    key: str = field(repr=False)
    key_header: str = "x-api-key"
    headers: dict[str, str] = field(default_factory=dict)
    max_tokens: int = 1200
    options: dict = field(default_factory=dict)

    def __call__(self, prompt: str) -> Answer:
        body = {"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]} | self.options
        r = _post(self.url, body, self.headers | {self.key_header: self.key})
        text = next((b.get("text") for b in r.get("content", []) if b.get("text")), None)
        use = r.get("usage", {})
        return Answer(text, None, 0.0, use.get("input_tokens", 0), use.get("output_tokens", 0))


@dataclass
class ConverseModel:
    """A model behind a converse interface, called through a client object that the caller makes on the executor."""

    model: str
    make_client: Callable[[], object]
    max_tokens: int = 1200
    top_p: float = 0.1
    temperature: float = 0.0

    def __call__(self, prompt: str) -> Answer:
        r = self.make_client().converse(modelId=self.model, messages=[{"role": "user", "content": [{"text": prompt}]}], inferenceConfig={"maxTokens": self.max_tokens, "topP": self.top_p, "temperature": self.temperature})
        use = r.get("usage", {})
        return Answer(r["output"]["message"]["content"][0]["text"], None, r.get("metrics", {}).get("latencyMs", 0) / 1000, use.get("inputTokens", 0), use.get("outputTokens", 0))


@dataclass
class FakeModel:
    """Two or three triplets of capitalised words of the prompt, chosen by its md5: the same for the same prompt."""

    def __call__(self, prompt: str) -> Answer:
        h = int(hashlib.md5(prompt.encode()).hexdigest(), 16)
        names = list(dict.fromkeys(w.strip(".,;:!?\"'()") for w in prompt.split() if w[:1].isupper() and len(w) > 3)) or ["Someone"]
        pick = lambda k: names[(h >> k) % len(names)]
        n = 2 + h % 2
        return Answer("[" + ", ".join(f"('{pick(3 * k)}', 'COMPANY', 'Supplies', 'SSI', '{pick(5 * k + 1)}', 'CONCEPT')" for k in range(n)) + "]", None, 0.0, len(prompt.split()), 6 * n)


#: Connectors by name; a hosted one is made with its address and key.
REGISTRY: dict[str, Callable[..., Callable[[str], Answer]]] = {"local": LocalServer, "messages": HostedMessages, "converse": ConverseModel, "fake": FakeModel}


def connect(kind: str, **options) -> Callable[[str], Answer]:
    if kind not in REGISTRY:
        raise ValueError(f"unknown connector {kind!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[kind](**options)


def asked(df: DataFrame, prompt: str, client: Callable[[str], Answer]) -> DataFrame:
    """``df`` with the answer to each prompt. An error is kept with its row and stops no other; null prompts are not
    asked. Callers write the result before they use it, so that nothing is asked twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for p in batch.column(prompt).to_pylist():
                try:
                    got.append(client(p) if p is not None else Answer())
                except Exception as e:  # noqa: BLE001 - any failure of a remote call belongs to its row
                    got.append(Answer(error=f"{type(e).__name__}: {e}"[:500]))
            new = [pa.array([a.text for a in got], pa.string()), pa.array([a.error for a in got], pa.string()), pa.array([a.seconds for a in got], pa.float64()), pa.array([a.tokens_in for a in got], pa.int64()), pa.array([a.tokens_out for a in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "answer", "error", "seconds", "tokens_in", "tokens_out"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {ANSWER}")


@functools.lru_cache(maxsize=100_000)
def hashed_vector(text: str, width: int = 64) -> np.ndarray:
    """A unit vector that depends on the text alone; a stand-in where there is no sentence model."""
    v = np.random.default_rng(int(hashlib.md5(text.encode()).hexdigest(), 16) % 2**32).uniform(-1, 1, width)
    return v / np.linalg.norm(v)


def word_vector(text: str, width: int = 64) -> np.ndarray:
    """The scaled sum of its words' vectors: texts that share words are similar."""
    ws = text.lower().split()
    v = sum((hashed_vector(w, width) for w in ws), np.zeros(width))
    n = np.linalg.norm(v)
    return v / n if n > 0 else hashed_vector(text, width)
