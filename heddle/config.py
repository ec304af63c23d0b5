"""Typed settings, from defaults or YAML; unknown keys are refused.

Settings of what lies outside this engine are taken, so that published files load, and read by nothing here:
dataset.kaggle_slug (downloads) and paths.figures_dir (plots). The two *_per_component settings of the cycle
search bound nothing: results are whole, and components beyond them are reported in the log.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


# The published defaults of the analyses.
@dataclass(frozen=True)
class Dataset:
    name: str = "HI-Small"
    kaggle_slug: str = ""

    @property
    def transactions_file(self) -> str:
        return f"{self.name}_Trans.csv"

    @property
    def patterns_file(self) -> str:
        return f"{self.name}_Patterns.txt"


@dataclass(frozen=True)
class Paths:
    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    models_dir: str = "models"
    figures_dir: str = "reports/figures"
    tables_dir: str = "reports/tables"


@dataclass(frozen=True)
class Graph:
    ego_max_nodes: int = 300


@dataclass(frozen=True)
class Detectors:
    cycle_length_bound: int = 6
    cycle_window_days: float = 14
    cycle_min_length: int = 2
    amount_tolerance: float = 0.20
    max_cycles_per_component: int = 100_000
    max_expansions_per_component: int = 20_000_000
    fan_windows_days: tuple[int, ...] = (1, 7)
    fan_percentile: float = 99.5
    fan_min_degree: int = 3
    scatter_gather_min_paths: int = 3
    scatter_gather_window_days: float = 7
    max_intermediary_txns: int = 2000
    pass_through_ratio_tol: float = 0.10
    pass_through_max_dwell_hours: float = 24.0
    pass_through_min_txns: int = 2
    pass_through_min_usd: float = 1000.0
    attempt_detection_threshold: float = 0.5
    max_txns_per_finding: int = 500


@dataclass(frozen=True)
class Anomaly:
    min_cluster_size: int = 50
    small_cluster_size: int = 200
    pca_components: int = 10
    lof_neighbors: int = 20
    contamination: float = 0.01
    iforest_estimators: int = 200
    precision_at_k: tuple[int, ...] = (100, 500, 1000)


@dataclass(frozen=True)
class Supervised:
    train_frac: float = 0.6
    val_frac: float = 0.2
    lookback_days: tuple[int, ...] = (1, 7, 30)
    pos_weight_power: float = 0.25
    era_cut: str = "2022-09-11"


@dataclass(frozen=True)
class Config:
    seed: int = 42
    dataset: Dataset = field(default_factory=Dataset)
    paths: Paths = field(default_factory=Paths)
    graph: Graph = field(default_factory=Graph)
    detectors: Detectors = field(default_factory=Detectors)
    anomaly: Anomaly = field(default_factory=Anomaly)
    supervised: Supervised = field(default_factory=Supervised)


SECTIONS = {"dataset": Dataset, "paths": Paths, "graph": Graph, "detectors": Detectors, "anomaly": Anomaly, "supervised": Supervised}


def section(kind: type, values: dict[str, Any] | None) -> Any:
    values = dict(values or {})
    if strange := sorted(set(values) - {f.name for f in fields(kind)}):
        raise ValueError(f"{kind.__name__} has no settings {strange}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(path: str | Path | None = None) -> Config:
    """Settings from a YAML file with a mapping for each section; the defaults without one."""
    if path is None:
        return Config()
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if strange := sorted(set(raw) - set(SECTIONS) - {"seed"}):
        raise ValueError(f"no section {strange}")
    out = {k: section(kind, raw.get(k)) for k, kind in SECTIONS.items()}
    return Config(seed=int(raw.get("seed", 42)), **out)
