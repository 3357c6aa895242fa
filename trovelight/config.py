"""Retrieval profiles: defaults, deep merge, validation and clamps."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

#: The default profile.
DEFAULT_PROFILE: dict[str, Any] = {
    "embedding": {"provider": "local-hash-v1", "dimensions": 128},
    "vector": {"topK": 20, "enabled": True},
    "fullText": {"topK": 20, "enabled": True},
    "fusion": {"method": "rrf", "k": 60, "vectorWeight": 1.0, "fullTextWeight": 1.0},
    "rerank": {"provider": "local-lexical-v1", "topK": 6},
    "prompt": {"maxEvidenceChars": 12000},
}
#: Least and most of numeric settings.
BOUNDS = {("embedding", "dimensions"): (8, 2048), ("fusion", "k"): (1, 1000), ("rerank", "topK"): (1, 50), ("vector", "topK"): (1, 1000), ("fullText", "topK"): (1, 1000)}
PROVIDERS = {"embedding": {"local-hash-v1"}, "rerank": {"local-lexical-v1"}}


def merge(base: dict, over: dict | None) -> dict:
    """Deep merge: nested objects merge, everything else is replaced."""
    out = deepcopy(base)
    for key, value in (over or {}).items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def profile(over: dict | None = None) -> dict:
    """The default profile with ``over``; ValueError where a setting is out of bounds or names an unknown provider."""
    out = merge(DEFAULT_PROFILE, over)
    for (group, name), (low, high) in BOUNDS.items():
        value = out[group][name]
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise ValueError(f"{group}.{name} must be an integer in {low}..{high}")
    for group, names in PROVIDERS.items():
        if out[group]["provider"] not in names:
            raise ValueError(f"unknown {group} provider")
    return out


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def normalise_weights(dense: float, sparse: float) -> tuple[float, float]:
    """Weights as shares; both finite, not negative and not both zero."""
    total = dense + sparse
    if not all(0 <= w < float("inf") for w in (dense, sparse)) or total <= 0:
        raise ValueError("weights must be finite, not negative, and sum to more than 0")
    return dense / total, sparse / total
