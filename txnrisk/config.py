"""Settings of a run: defaults here, overridden by a YAML or JSON file."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Config:
    # period lengths in days from the first date of the data; the tail is the rest
    warmup_days: int = 1
    train_days: int = 5
    validation_days: int = 2
    test_days: int = 2
    # graph features
    damping: float = 0.85
    pagerank_iterations: int = 20
    # trees
    tree_depth: int = 5
    tree_rounds: int = 50
    tree_bins: int = 64
    subsampling: float = 0.8
    seeds: tuple[int, ...] = (42, 43, 44)
    parallel_fits: int = 4
    # evaluation
    bootstrap_replicates: int = 200
    bootstrap_seed: int = 42
    confidence: float = 0.95
    alert_budget: float = 0.01
    shap_top: int = 5
    subgraph_hops: int = 1
    # stop a job whose features see their own day or later ones
    leakage_checks: bool = True


def load_config(path: str | None = None) -> Config:
    """Read overrides from ``path``; unknown keys are an error."""
    if path is None:
        return Config()
    text = Path(path).read_text()
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        import yaml

        values = yaml.safe_load(text) or {}
    known = {f.name for f in dataclasses.fields(Config)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if "seeds" in values:
        values["seeds"] = tuple(values["seeds"])
    return Config(**values)
