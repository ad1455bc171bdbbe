"""Encoding settings: defaults, options and range checks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, functions as F

# fixed values: highest preset and CRF, and the bounds of chunk lengths
MAX_PRESET, MAX_CRF, MIN_SECONDS, MAX_SECONDS = 13, 63, 1.0, 120.0


@dataclass(frozen=True)
class Config:
    """Settings with their defaults; ``check`` tells what is out of range."""

    preset: int = 6
    tune: int = 0
    crf_sd: int = 25
    crf_hd: int = 27
    crf_uhd: int = 29
    workers: int = 24
    chunk_buffer: int = 4
    chunk_duration_sd: float = 20.0
    chunk_duration_hd: float = 30.0
    chunk_duration_uhd: float = 45.0
    disable_autocrop: bool = False
    ac_bias: float = 0.1
    variance_boost: bool = False

    def with_crf(self, *values: int) -> "Config":
        """One CRF for all sizes, or three for SD, HD and UHD."""
        sd, hd, uhd = values if len(values) == 3 else values * 3
        return replace(self, crf_sd=sd, crf_hd=hd, crf_uhd=uhd)

    def with_options(self, **options) -> "Config":
        return replace(self, **options)

    def check(self) -> list[str]:
        return [f.name for f in fields(self) if not in_range(f.name, getattr(self, f.name))]

    def crf_by_tier(self) -> dict[str, int]:
        return {"UHD": self.crf_uhd, "HD": self.crf_hd, "SD": self.crf_sd}

    def seconds_by_tier(self) -> dict[str, float]:
        return {"UHD": self.chunk_duration_uhd, "HD": self.chunk_duration_hd, "SD": self.chunk_duration_sd}


def _bounds(name: str) -> tuple[float, float]:
    if name == "preset":
        return 0, MAX_PRESET
    if name.startswith("crf_"):
        return 0, MAX_CRF
    if name == "workers":
        return 1, float("inf")
    if name == "chunk_buffer":
        return 0, float("inf")
    if name.startswith("chunk_duration_"):
        return MIN_SECONDS, MAX_SECONDS
    return float("-inf"), float("inf")


def in_range(name: str, value: float) -> bool:
    low, high = _bounds(name)
    return low <= value <= high


def setting_valid(name: Column, value: Column) -> Column:
    """``in_range`` for columns of setting names and values."""
    out = F.when(name == "preset", value.between(0, MAX_PRESET)).when(name.startswith("crf_"), value.between(0, MAX_CRF))
    out = out.when(name == "workers", value >= 1).when(name == "chunk_buffer", value >= 0)
    return out.when(name.startswith("chunk_duration_"), value.between(MIN_SECONDS, MAX_SECONDS)).otherwise(F.lit(True))
