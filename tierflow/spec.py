"""The pipeline's declaration: typed, checked when it is loaded."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

RULE_TYPES = ("not_null", "range", "accepted_values", "regex", "expression", "unique", "foreign_key")
LAYERS = ("landing", "bronze", "silver", "gold", "quarantine", "audit")


@dataclass(frozen=True)
class RuleSpec:
    name: str
    type: str
    severity: str = "error"
    column: str | None = None
    columns: tuple[str, ...] = ()
    values: tuple[Any, ...] = ()
    min: Any = None
    max: Any = None
    pattern: str | None = None
    expr: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None

    def __post_init__(self) -> None:
        needs = {
            "not_null": ("columns",),
            "unique": ("columns",),
            "range": ("column",),
            "accepted_values": ("column", "values"),
            "regex": ("column", "pattern"),
            "expression": ("expr",),
            "foreign_key": ("column", "ref_table", "ref_column"),
        }
        if self.type not in needs:
            raise ValueError(f"rule {self.name}: unknown rule type {self.type}")
        if self.severity not in ("error", "warn"):
            raise ValueError(f"rule {self.name}: unknown severity {self.severity}")
        if missing := [n for n in needs[self.type] if not getattr(self, n)]:
            raise ValueError(f"rule {self.name}: {', '.join(missing)} must be given")

    @classmethod
    def of(cls, raw: Mapping[str, Any]) -> RuleSpec:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


@dataclass(frozen=True)
class SourceSpec:
    name: str
    format: str
    load_type: str
    schema: str
    primary_key: tuple[str, ...]
    options: Mapping[str, str] = field(default_factory=dict)
    tracked: tuple[str, ...] = ()
    change_ts: str | None = None
    event_ts: str | None = None

    def __post_init__(self) -> None:
        if self.format not in ("csv", "json"):
            raise ValueError(f"source {self.name}: unknown format {self.format}")
        if self.load_type not in ("cdc", "snapshot", "incremental"):
            raise ValueError(f"source {self.name}: unknown load type {self.load_type}")


@dataclass(frozen=True)
class QualitySpec:
    rules: tuple[RuleSpec, ...] = ()
    max_error_rate: float = 1.0


@dataclass(frozen=True)
class PipelineSpec:
    base_path: str
    sources: Mapping[str, SourceSpec]
    quality: Mapping[str, QualitySpec]
    pii: Mapping[str, Mapping[str, tuple[str, ...]]]
    rates: Mapping[str, float]
    late_days: int = 3
    lookback_days: int = 30
    shuffle_partitions: int = 64
    layers: Mapping[str, str] = field(default_factory=lambda: {n: n for n in LAYERS})

    def source(self, name: str) -> SourceSpec:
        if name not in self.sources:
            raise KeyError(f"unknown source {name}; declared are {', '.join(sorted(self.sources))}")
        return self.sources[name]

    def rules_of(self, dataset: str) -> QualitySpec:
        return self.quality.get(dataset, QualitySpec())

    def path(self, layer: str, table: str) -> str:
        return f"{self.base_path.rstrip('/')}/{self.layers[layer]}/{table}"


def parse(raw: Mapping[str, Any], base_path: str | None = None) -> PipelineSpec:
    """Check and type a declaration; the base path is the argument, else TIERFLOW_BASE_PATH, else the file's."""
    sources = {
        n: SourceSpec(n, s["format"], s["load_type"], " ".join(s["schema"].split()), tuple(s["primary_key"]), dict(s.get("options") or {}), tuple(s.get("tracked", ())), s.get("change_ts"), s.get("event_ts"))
        for n, s in raw["sources"].items()
    }
    quality = {n: QualitySpec(tuple(map(RuleSpec.of, q.get("rules", ()))), float(q.get("max_error_rate", 1.0))) for n, q in (raw.get("quality") or {}).items()}
    for dataset, q in quality.items():
        names = [r.name for r in q.rules]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"{dataset}: rules of one name: {', '.join(sorted(twice))}")
        if lost := [r.name for r in q.rules if r.type == "foreign_key" and r.ref_table not in sources]:
            raise ValueError(f"{dataset}: rules without a declared reference: {', '.join(lost)}")
    run = raw.get("processing") or {}
    return PipelineSpec(
        base_path or os.environ.get("TIERFLOW_BASE_PATH") or raw.get("base_path", "data"),
        sources,
        quality,
        {n: {k: tuple(v) for k, v in p.items()} for n, p in (raw.get("pii") or {}).items()},
        {k: float(v) for k, v in (raw.get("rates") or {}).items()},
        int(run.get("late_days", 3)),
        int(run.get("lookback_days", 30)),
        int(run.get("shuffle_partitions", 64)),
        {n: (raw.get("layers") or {}).get(n, n) for n in LAYERS},
    )


def load(location: str, base_path: str | None = None, spark: Any = None) -> PipelineSpec:
    """Read a YAML declaration from a local path, or by Spark from any file system it reaches (a URI)."""
    import yaml

    if "://" in location:
        if spark is None:
            raise ValueError(f"reading {location} needs a session")
        text = spark.read.text(location, wholetext=True).first()[0]
    else:
        text = Path(location).read_text(encoding="utf-8")
    return parse(yaml.safe_load(text), base_path)
