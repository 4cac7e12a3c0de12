"""Axis orders, validated and turned into column names; rounding of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def checked(order: str, what: str = "order") -> str:
    """``order`` in lower case; ValueError unless xyz or zyx."""
    low = order.lower()
    if low not in ("xyz", "zyx"):
        raise ValueError(f"{what} must be 'xyz' or 'zyx', not {order!r}")
    return low


def sampling_zyx(voxel_size: tuple[float, float, float], vox_order: str = "xyz") -> tuple[float, float, float]:
    sizes = tuple(float(v) for v in voxel_size)
    return sizes if checked(vox_order, "vox_order") == "zyx" else sizes[::-1]  # type: ignore[return-value]


def to_zyx(df: DataFrame, columns: tuple[str, str, str], order: str = "xyz") -> DataFrame:
    """Rename three coordinate columns, given in ``order``, to z, y and x."""
    names = columns if checked(order) == "zyx" else columns[::-1]
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *(F.col(c).alias(a) for c, a in zip(names, AXES)))


def from_zyx(df: DataFrame, columns: tuple[str, str, str], order: str = "xyz") -> DataFrame:
    """Rename z, y and x to three columns in ``order``."""
    names = columns if checked(order) == "zyx" else columns[::-1]
    kept = [c for c in df.columns if c not in AXES]
    by_axis = dict(zip(AXES, names))
    wanted = AXES if checked(order) == "zyx" else AXES[::-1]
    return df.select(*kept, *(F.col(a).alias(by_axis[a]) for a in wanted))


def rounded(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(c).cast("long")


def half_up(c: Column) -> Column:
    """floor(c + 0.5)."""
    return F.floor(c + 0.5).cast("long")


def clamped(c: Column, low: Column | int, high: Column | int) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return F.least(F.greatest(c, low), high)


def seeds_to_zyx(seeds: DataFrame, columns: tuple[str, str, str], order: str = "xyz") -> DataFrame:
    out = to_zyx(seeds, columns, order)
    return out.withColumns({a: rounded(F.col(a)) for a in AXES})


def linear(z: Column, y: Column, x: Column, ny: Column, nx: Column) -> Column:
    """Row-major number of a voxel in its volume."""
    return ((z * ny + y) * nx + x).cast("long")
