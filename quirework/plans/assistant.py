"""The assistant's turns: routing, memory commands, strain methods, answers, research."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession, functions as F

from ..functions import vocabulary as V
from ..operators import grid
from ..sources import formats
from ..sources.results import Registry, result_key
from . import answer, research
from .config import PHYSICAL_DEFAULTS, STRAIN_DEFAULTS, Settings, overlay
from .models import Chat, MatrixModel

CATEGORIES = ("preference", "fact", "project", "note")


class Memory:
    """Remembered items by category, in a JSON file that is replaced as a whole."""

    def __init__(self, path: str):
        from pathlib import Path

        self.path = Path(path)

    def load(self) -> dict[str, list[dict]]:
        found = json.loads(self.path.read_text()) if self.path.exists() else {}
        return {c: found.get(c, []) for c in CATEGORIES}

    def _save(self, items: dict) -> None:
        import os

        fresh = self.path.with_suffix(".new")
        fresh.write_text(json.dumps(items, ensure_ascii=False))
        os.replace(fresh, self.path)

    def remember(self, content: str, category: str = "preference") -> dict:
        from datetime import datetime

        item = {"content": content.strip(), "created_at": datetime.now().isoformat(timespec="seconds")}
        if item["content"]:
            items = self.load()
            items[category if category in CATEGORIES else CATEGORIES[0]].append(item)
            self._save(items)
        return item

    def forget(self, text: str) -> int:
        """Removes the items that hold a text; an empty text removes none."""
        if not text:
            return 0
        items = self.load()
        kept = {c: [i for i in rows if text not in i["content"]] for c, rows in items.items()}
        self._save(kept)
        return sum(map(len, items.values())) - sum(map(len, kept.values()))

    def summary(self, most: int = 8) -> str:
        lines = [f"- {c}: {i['content'].strip()}" for c, rows in self.load().items() for i in rows[-most:] if i["content"].strip()]
        return "\n".join(lines[-most:])


def memory_command(text: str, memory: Memory) -> str | None:
    bare = text.strip()
    if bare.startswith("记住"):
        return f"已记住：{memory.remember(re.sub('^记住[:：]?', '', bare))['content']}"
    if bare.startswith("忘记"):
        return f"已删除 {memory.forget(re.sub('^忘记[:：]?', '', bare).strip())} 条相关记忆。"
    if "查看记忆" in bare:
        return memory.summary() or "当前还没有长期记忆。"
    return None


def route_of(text: str, has_files: bool = False) -> str | None:
    """The route that a message's words choose (the same rule as the column expression)."""
    low = text.lower()
    has = lambda words: any(w in low for w in words)
    for name, words in V.ROUTES.items():
        if has(words) and (name != "strain_estimation" or ((not has(V.KNOWLEDGE_WORDS) or has(V.COMPUTE_WORDS)) and (has_files or has(V.COMPUTE_WORDS)))):
            return name
    return None


def classify_error(error: Exception) -> dict:
    """A tool's error as (kind, retry)."""
    kinds = ((FileNotFoundError, "file_not_found", False), (KeyError, "unknown_file", False), (NotImplementedError, "model_unavailable", False), (ValueError, "invalid_input", True), (MemoryError, "out_of_memory", False))
    kind, retry = next(((k, r) for t, k, r in kinds if isinstance(error, t)), ("internal_error", False))
    return {"success": False, "error_type": kind, "retryable": retry, "message": str(error)}


class StrainTools:
    """The strain methods over uploaded matrices: the vector method as DataFrame operators, networks as plug-ins."""

    def __init__(self, spark: SparkSession, registry: Registry, cnn: MatrixModel | None = None, bnn: MatrixModel | None = None):
        self.spark, self.registry, self.models = spark, registry, {"cnn": cnn, "bnn": bnn}

    def run(self, method: str, run_folder: str, file_id: str = "", file_ids: list[str] | None = None, path: str = "", physical: dict | None = None, **options) -> str:
        """A result's reference, or a classified error, as JSON."""
        try:
            chosen = file_id if not file_ids or file_id in file_ids else file_ids[0]
            file_id, source = self.registry.resolve(chosen or (file_ids or [None])[0], path or None)
            with open(source, "rb") as file:
                content = file.read()
            arrays, key = self._arrays(method, content, overlay(PHYSICAL_DEFAULTS, physical), overlay(STRAIN_DEFAULTS, options))
            made = self.registry.save(run_folder, source, key, arrays, file_id)
            return json.dumps({"success": True, "result_id": made.result_id, "result_key": key, "outputs": made.outputs})
        except Exception as e:
            return json.dumps(classify_error(e), ensure_ascii=False)

    def _arrays(self, method: str, content: bytes, physical: dict, s: dict) -> tuple[dict, str]:
        if method == "vector":
            _, matrix = formats.single_matrix(content)
            if len(matrix) < 2:
                raise ValueError("the matrix has too few rows")
            r, c = np.indices(matrix.shape)
            cells = self.spark.createDataFrame(list(zip(["m"] * matrix.size, r.ravel().tolist(), c.ravel().tolist(), matrix.ravel().tolist())), "matrix_id string, r int, c int, v double")
            rows = grid.as_rows(grid.vector_strain(cells, s["Nx"], s["Nz"], s["g"], **physical)).orderBy("r").collect()
            return {"strain": np.array([x.row for x in rows]).reshape(len(rows), -1)}, result_key("vector", g=s["g"], Nx=s["Nx"], Nz=s["Nz"])
        if method not in self.models:
            raise ValueError(f"unknown method: {method}")
        if self.models[method] is None:
            raise NotImplementedError(f"no {method} model is loaded")
        _, matrix = formats.single_matrix(content)
        # only the network with dropout needs sides that its levels divide
        h, w = (n - n % 32 if method == "bnn" else n for n in matrix.shape)
        top, left = (matrix.shape[0] - h) // 2, (matrix.shape[1] - w) // 2
        n = s["MC_test"] if method == "bnn" else 1
        samples = np.asarray(self.models[method].infer(matrix[top : top + h, left : left + w], n), float)
        strain = lambda phase: np.nan_to_num(phase * physical["wavelength"] / (4 * np.pi * physical["refractive_index"]) * 1e3 / (physical["wavelength"] ** 2 / physical["bandwidth"]), nan=0.0)
        out = {"strain": strain(samples.mean(0))}
        if method == "bnn":
            out["epistemic_uncertainty"] = strain(samples.std(0, ddof=1))
        return out, result_key(method, MC_test=n)


@dataclass
class Turn:
    text: str
    requested: str | None = None
    research_pending: bool = False
    methods: tuple[str, ...] = ()
    file_ids: list[str] = field(default_factory=list)
    recent: str = ""


class Assistant:
    """One turn after another: to the knowledge base, research, strain methods or chat."""

    def __init__(self, spark: SparkSession, kb, chat: Chat, memory: Memory, sources=(), tools: StrainTools | None = None, s: Settings | None = None):
        self.spark, self.kb, self.chat, self.memory, self.sources, self.tools, self.s = spark, kb, chat, memory, list(sources), tools, s or Settings()

    def route(self, turn: Turn) -> str:
        if turn.requested:
            return turn.requested
        if turn.research_pending:
            return "deep_research"
        if turn.methods and turn.file_ids:
            return "strain_estimation"
        bare = turn.text.strip()
        if bare.startswith(("记住", "忘记")) or "查看记忆" in bare or "清除摘要" in bare:
            return "chat"
        return route_of(turn.text, bool(turn.file_ids)) or "self_rag"

    def respond(self, turn: Turn) -> dict:
        way = self.route(turn)
        if way == "deep_research":
            done = research.run(self.spark, turn.text, self.sources, self.chat, self.s, turn.research_pending)
            return {"route": way, "text": done.question if done.pending else done.report, "research_pending": done.pending}
        if way == "strain_estimation" and self.tools is not None:
            run = self.tools.registry.run_folder("strain_estimation")
            return {"route": way, "results": [json.loads(self.tools.run(m, run, file_ids=turn.file_ids)) for m in turn.methods or ("vector",)]}
        if way == "self_rag":
            need, trace = answer.gate(self.kb.is_empty(), turn.recent or turn.text, self.chat)
            if need:
                state = answer.run(turn.text, _Bound(self.kb, self.chat), self.chat, self.s)
                low = state.generation.lower()
                if not (state.error or not state.documents or any(m in low for m in V.FALLBACK_MARKERS)):
                    return {"route": way, "text": answer.message(state), "gate": trace}
        if "清除摘要" in turn.text:
            return {"route": "chat", "text": "已清除对话摘要，后续对话将重新积累上下文。"}
        said = memory_command(turn.text, self.memory)
        if said is None:
            said = self.chat.generate([{"role": "system", "content": self.memory.summary()}, {"role": "user", "content": turn.text}])
        return {"route": "chat", "text": said}


class _Bound:
    def __init__(self, kb, chat: Chat):
        self.kb, self.chat = kb, chat

    def retrieve(self, query: str) -> dict:
        return self.kb.retrieve(query, self.chat)


def summarized(messages: list[dict], state: dict, chat: Chat, s: Settings | None = None) -> dict:
    """A conversation's summary, extended by the messages that fall out of the recent ones; unchanged if short or on failure."""
    from . import prompts

    s = s or Settings()
    upto, done = len(messages) - s.keep_recent, state.get("summary_message_count", 0)
    if len(messages) <= s.summarize_threshold or upto <= done:
        return {}
    text = "\n".join(f"{m['role']}: {m['content']}" for m in messages[done:upto])
    try:
        return {"conversation_summary": chat.generate(prompts.summary(text, state.get("conversation_summary", ""))).strip(), "summary_message_count": upto}
    except Exception:
        return {}


def literal_states(spark: SparkSession, rows: list[tuple]):
    """A table of loop states, for truth tables: error, n_documents, retrievals, grounded, useful, generations."""
    return spark.createDataFrame(rows, "error string, n_documents int, retrievals int, grounded boolean, useful boolean, generations int").withColumns(
        {"after_documents": answer.after_documents(F.col("error"), F.col("n_documents"), F.col("retrievals")), "after_generation": answer.after_generation(F.col("error"), F.col("grounded"), F.col("useful"), F.col("generations"), F.col("retrievals"))}
    )
