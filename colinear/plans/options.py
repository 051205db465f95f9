"""Settings of the composite jobs. Every default is the published constant where there is one."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChainOptions:
    local: bool = False
    weighted: bool = False
    match: float = 5.0
    mismatch: float = -1.0
    gap: float = -1.0
    center: float | None = 5.0
    missing_weight: float | None = None
    renumber: bool = True
    compat: bool = False


@dataclass(frozen=True)
class SearchOptions:
    k: int = 4
    multiplier: float = 1.2
    match: float = 5.0
    mismatch: float = -1.0
    gap: float = -1.0
    threshold: float = 20.0
    break_distance: int = 3000
    both_directions: bool = True
    align_most: float | None = None
    center: float | None = 5.0


@dataclass(frozen=True)
class ClusterOptions:
    local: bool = False
    alpha: float = 0.5
    beta: float = 1.0
    scale: float = 1.0
    threshold: float = 0.9
    more_than: int = 4
    least_consensus: int = 5


@dataclass(frozen=True)
class RankOptions:
    ranks: tuple[int, ...] = (1, 2, 3, 4, 5)
    bands: tuple[tuple[int, int], ...] = tuple((low, low + 100) for low in range(650, 2050, 100))
    align_percent: float | None = None
    align_most: float | None = None
    fractions: tuple[float, ...] = (0.25, 0.4, 0.79)
    lengths: tuple[int, ...] = tuple(range(2, 20))
