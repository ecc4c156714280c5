"""Settings, from the environment where it names them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass
class Settings:
    data_folder: str = "data"
    tokenizer: str = "char"
    domain_terms_path: str = ""
    word_frequencies_path: str = ""
    cjk_bigrams: bool = True
    use_hyde: bool = True
    use_rerank: bool = True
    retrieval_top_k: int = 50
    final_k: int = 10
    context_parent_top_k: int = 6
    expand_to_parent: bool = True
    max_retrieval_attempts: int = 2
    max_generation_attempts: int = 2
    generation_max_tokens: int = 1200
    grading_max_tokens: int = 400
    parent_chunk_max_tokens: int = 1800
    parent_chunk_min_tokens: int = 300
    child_chunk_size: int = 500
    child_chunk_overlap: int = 80
    enable_cleaning: bool = True
    exclude_references: bool = True
    repeated_headers: bool = True
    repeated_header_min_pages: int = 2
    mojibake_extra_chars: str = ""
    segments_before_compaction: int = 8
    vectors_before_index: int = 20_000
    exact_neighbours: bool = False
    ocr: str = "auto"
    ocr_sample_pages: int = 5
    ocr_min_text_chars: int = 300
    research_topics: int = 4
    research_queries: int = 3
    research_results: int = 3
    research_timeout_s: float = 120.0
    summarize_threshold: int = 20
    keep_recent: int = 6


def truth(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on")


def settings(environment: dict[str, str] | None = None, prefix: str = "QUIREWORK_", **given) -> Settings:
    """Defaults, under the environment's values (QUIREWORK_<NAME>), under those given."""
    env, found = os.environ if environment is None else environment, {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper())
        if raw is not None:
            found[f.name] = truth(raw) if isinstance(f.default, bool) else type(f.default)(raw)
    return Settings(**found | given)


def overlay(defaults: dict, own: dict | None) -> dict:
    """Defaults under a user's values; null values don't count."""
    return defaults | {k: v for k, v in (own or {}).items() if v is not None}


STRAIN_DEFAULTS = {"vector": False, "cnn": False, "bnn": False, "Nx": 25, "Nz": 25, "g": 1, "MC_test": 50}
PHYSICAL_DEFAULTS = {"wavelength": 840e-9, "bandwidth": 50e-9, "refractive_index": 1.0}
