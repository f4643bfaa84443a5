"""Layered settings: defaults, then a TOML file, then environment variables, each coerced to its default's type."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of settings and their defaults.
DEFAULTS: dict[str, dict[str, float | int]] = {
    "retrieval": {"vector_weight": 0.7, "keyword_weight": 0.3, "rerank_model_weight": 0.8, "rerank_base_weight": 0.2, "low_confidence_threshold": 0.25, "candidate_pool_size": 20, "final_chunk_count": 6, "fallback_scan_limit": 2_000},
    "chunking": {"latin_target_chars": 800, "cjk_target_chars": 400, "overlap_sentences": 1},
    "embedding": {"batch_size": 64, "max_concurrency": 4},
    "retry": {"max_attempts": 3, "base_delay_seconds": 0.5},
    "jobs": {"visibility_timeout_seconds": 1_800, "max_attempts": 3, "poll_seconds": 2},
    "runtime": {"lease_seconds": 90, "max_upload_files": 5, "suggestions_ttl_hours": 24, "briefing_ttl_hours": 24},
}


def load_config(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "TESSELLA") -> dict[str, dict[str, float | int]]:
    """Settings by group; variables are PREFIX_GROUP_KEY. A value that can't be coerced is an error."""
    env = dict(os.environ) if env is None else env
    file = tomllib.loads(Path(path).read_text("utf-8")) if path and Path(path).exists() else {}
    out: dict[str, dict[str, float | int]] = {}
    for group, defaults in DEFAULTS.items():
        out[group] = {}
        for key, default in defaults.items():
            value = env.get(f"{prefix}_{group}_{key}".upper(), file.get(group, {}).get(key, default))
            try:
                out[group][key] = type(default)(value)
            except (TypeError, ValueError) as e:
                raise ValueError(f"{group}.{key}: {value!r} is no {type(default).__name__}") from e
    return out


def fingerprint(settings: dict, secrets: tuple[str, ...] = ("api_key", "secret", "password")) -> str:
    """SHA-256 of the canonical JSON of settings without secrets."""
    kept = {k: v for k, v in settings.items() if not any(s in k.lower() for s in secrets)}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def fingerprint_column(settings: Column, secrets: tuple[str, ...] = ("api_key", "secret", "password")) -> Column:
    """fingerprint() of a map of strings as a column: its keys in order, without secrets."""
    kept = F.filter(F.array_sort(F.map_entries(settings)), lambda e: ~F.exists(F.array(*map(F.lit, secrets)), lambda s: F.contains(F.lower(e.key), s)))
    pairs = F.transform(kept, lambda e: F.concat(F.lit('"'), e.key, F.lit('": "'), e.value, F.lit('"')))
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), 256)
