"""Model plug-ins: protocols, deterministic stand-ins, structured output.

Remote and local models aren't bundled: whoever has one passes an object with these methods. Vectorised
wrappers run an embedder on the executors, loaded once for each worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, functions as F


class Chat(Protocol):
    def generate(self, messages: list[dict[str, str]], temperature: float = 0.0, max_tokens: int = 1024, json_mode: bool = False) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Retriever(Protocol):
    def retrieve(self, query: str) -> dict[str, Any]: ...


class MatrixModel(Protocol):
    """A network over matrices: ``samples`` maps are returned for one matrix (1 for a deterministic network)."""

    def infer(self, matrix, samples: int = 1): ...


class ScriptedChat:
    """A stand-in that answers by a function of the messages."""

    def __init__(self, answer: Callable[[list[dict[str, str]]], str]):
        self.answer, self.asked = answer, []

    def generate(self, messages, temperature=0.0, max_tokens=1024, json_mode=False) -> str:
        self.asked.append(messages)
        return self.answer(messages)


class HashedEmbedder:
    """A stand-in: words hashed to dimensions with a sign, length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 40 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def embedded(text: Column, make: Callable[[], Embedder]) -> Column:
    """Embeddings of a text column; ``make`` is called once for each worker task."""
    from pyspark.sql import SparkSession

    from ..sources.formats import prepare_workers

    prepare_workers(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model.embed(batch.fillna("").tolist()))

    return run(text)


def as_json(raw: str, fallback: dict) -> dict:
    """The object a text is or holds between its first { and last }; else the fallback with the text as raw."""
    for part in (raw, raw[raw.find("{") : raw.rfind("}") + 1] if "{" in raw else ""):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return {**fallback, "raw": raw}


def structured(chat: Chat, messages: list[dict[str, str]], check: Callable[[dict], Any], fallback: Callable[[], Any]) -> Any:
    """A validated object from a model: with JSON mode, then without, then the fallback."""
    for json_mode in (True, False):
        try:
            return check(as_json(chat.generate(messages, json_mode=json_mode), {}))
        except Exception:
            continue
    return fallback()


def yes(value: Any) -> bool:
    from ..functions.vocabulary import YES

    return str(value).strip().lower() in YES


def as_prompt(messages: list[dict[str, str]]) -> str:
    return "\n".join(f"<|{m['role']}|>\n{m['content']}" for m in messages) + "\n<|assistant|>\n"
