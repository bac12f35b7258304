"""Parameters of the listing operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    max_price: int = 7_500_000
    min_area: int = 40
    grace_days: int = 180
    min_age_days: int = 100
    max_attempts: int = 5
    max_minutes: int = 360
    fit_minutes: int = 70
    fit_area: int = 80
    radius_m: float = 300.0
    closed: tuple[str, ...] = ("solgt", "inaktiv")
    excluded_paths: tuple[str, ...] = ("newbuildings", "lettings", "projects")
    #: Corners (lng, lat) of the area of interest.
    polygon: tuple[tuple[float, float], ...] = ((10.1, 59.65), (11.2, 59.62), (11.4, 59.95), (10.9, 60.15), (10.3, 60.05))
    #: Bounds of plausible coordinates: lat from, lat to, lng from, lng to.
    bounds: tuple[float, float, float, float] = (57.0, 72.0, 4.0, 32.0)
    travel: tuple[str, ...] = field(default=("brj", "mvv"))


CONFIG = Config()
