"""Settings of the data plane, from a mapping or a JSON or YAML file; unknown keys are dropped."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

CRITERIA = ("no_solution_reveal", "bug_localization", "usefulness", "socratic_style", "technical_accuracy")


@dataclasses.dataclass(frozen=True)
class Settings:
    """What the operators take as parameters. topics: name to first weight."""

    topics: Mapping[str, float]
    reward_weights: Mapping[str, float] = dataclasses.field(default_factory=lambda: {"no_solution_reveal": 0.2, "bug_localization": 0.2, "usefulness": 0.25, "socratic_style": 0.15, "technical_accuracy": 0.2})
    iteration_size: int = 8
    episode_batch_size: int = 4
    batch_spread_strength: float = 0.15
    bad_task_threshold: float = 3.0
    mining_bottom_fraction: float = 0.25
    reward_ema_alpha: float = 0.2
    low_reward_boost: float = 1.5
    iteration_weak_topic_boost: float = 0.15
    repeat_topic_reset_threshold: int = 5
    min_hard_examples: int = 4
    max_sft_examples: int = 256
    max_dpo_pairs: int = 128
    min_episodes: int = 2
    max_episodes: int = 10
    hard_buffer_max_size: int = 2048
    keep_last_n_checkpoints: int = 2
    checkpoint_every_episodes: int = 10
    min_code_lines_for_repair: int = 15
    probabilistic_repair_probability: float = 0.5
    timeout_seconds: float = 12.0
    max_capture_chars: int = 1600
    max_attempts: int = 4

    def __post_init__(self) -> None:
        if not self.topics:
            raise ValueError("at least one topic is needed")


def settings(values: Mapping[str, Any]) -> Settings:
    """Settings from a flat or nested mapping. Values are cast to the type of the default; reward weights keep the known criteria.

    Raises TypeError for what is no mapping, ValueError without topics.
    """
    if not isinstance(values, Mapping):
        raise TypeError("settings are a mapping")
    flat: dict[str, Any] = {}

    def walk(m: Mapping[str, Any]) -> None:
        for k, v in m.items():
            if isinstance(v, Mapping) and k not in ("topics", "reward_weights"):
                walk(v)
            else:
                flat[_NAMES.get(k, k)] = v

    walk(values)
    topics = flat.get("topics") or {}
    if not isinstance(topics, Mapping):
        topics = {str(t["name"] if isinstance(t, Mapping) else t): float(t.get("weight", 1.0)) if isinstance(t, Mapping) else 1.0 for t in topics}
    out: dict[str, Any] = {"topics": {str(k): float(v) for k, v in topics.items()}}
    for f in dataclasses.fields(Settings):
        if f.name in flat and f.name not in ("topics", "reward_weights"):
            out[f.name] = {"int": int, "float": float}[str(f.type)](flat[f.name])
    if isinstance(flat.get("reward_weights"), Mapping):
        out["reward_weights"] = {k: float(v) for k, v in flat["reward_weights"].items() if k in CRITERIA}
    return Settings(**out)


#: Keys of a configuration file that go under another name here.
_NAMES = {"max_red_generation_attempts": "max_attempts", "capture_max_chars": "max_capture_chars"}


def load_settings(path: str) -> Settings:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML package; use JSON instead") from e
        return settings(yaml.safe_load(text))
    return settings(json.loads(text))
