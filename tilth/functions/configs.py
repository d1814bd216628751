"""Settings and what makes them valid."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date


def load(path: str) -> dict:
    """A YAML (or JSON) file as a dict; anything else than a mapping is an error."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found


@dataclass(frozen=True)
class Classifier:
    """Channels of a picture classifier, and the quantiles that divide its classes."""

    channels: int
    names: tuple[str, ...]
    quantiles: tuple[float, ...]

    def __post_init__(self):
        if self.channels != len(self.names):
            raise ValueError(f"{self.channels} channels, but {len(self.names)} names")
        rising = all(a < b for a, b in zip(self.quantiles, self.quantiles[1:], strict=False))
        if not (rising and all(0 < q < 1 for q in self.quantiles)):
            raise ValueError("quantiles must ascend within (0, 1)")


@dataclass(frozen=True)
class Weights:
    ndvi: float
    ndre: float

    def __post_init__(self):
        if min(self.ndvi, self.ndre) < 0 or self.ndvi + self.ndre <= 0:
            raise ValueError("weights must not be negative, nor all 0")


@dataclass(frozen=True)
class Band:
    """A phase from ``start`` to ``end`` degree days."""

    name: str
    start: float
    end: float

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"{self.name} ends before it starts")


@dataclass(frozen=True)
class Season:
    first: date
    last: date


CHALLENGERS = 7


def benchmark(families: list[str]) -> tuple[str, ...]:
    """The families of a frozen benchmark: exactly seven, all different."""
    if len(families) != CHALLENGERS or len(set(families)) != CHALLENGERS:
        raise ValueError(f"a benchmark has {CHALLENGERS} different families")
    return tuple(families)


def accepted(make, *args) -> bool:
    """Whether settings are valid."""
    try:
        make(*args)
    except ValueError:
        return False
    return True
