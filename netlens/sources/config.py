"""Settings from a TOML file; given arguments win, unknown keys are ignored."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    window: float = 600.0  # detect
    gap: float = 300.0
    watchlist: str | None = None
    prefix: str = "events"  # sensor
    idle: float = 60.0
    active: float = 3600.0
    blind: float = 600.0
    max_age: float | None = None  # retention
    max_bytes: int | None = None
    min_severity: str = "low"  # alert


SECTIONS = {"sensor": ("prefix", "idle", "active", "blind"), "retention": ("max_age", "max_bytes"), "alert": ("min_severity",), "detect": ("window", "gap", "watchlist")}


def load_config(path: str | None = None, **given) -> Config:
    values = {}
    if path:
        with open(path, "rb") as f:
            parsed = tomllib.load(f)
        for section, names in SECTIONS.items():
            values |= {n: parsed[section][n] for n in names if n in parsed.get(section, {})}
    known = {f.name for f in fields(Config)}
    values |= {k: v for k, v in given.items() if k in known and v is not None}
    return replace(Config(), **values)
