"""Largest parameters accepted and answers given."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Fixed values as defaults: largest radius, largest number of results, longest geometry
    text.  Distances are exact up to a radius of 50 km.

    ``null_is_omitted``: a null ``max_radius_m`` counts as a call that omits it; otherwise
    it is an error, like any other value that is no number."""

    max_radius_m: int = 50_000
    max_results: int = 100
    geometry_text_cap: int = 10_000
    null_is_omitted: bool = True

    def __post_init__(self):
        for name in ("max_radius_m", "max_results", "geometry_text_cap"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1: {getattr(self, name)}")


DEFAULT_LIMITS = Limits()
