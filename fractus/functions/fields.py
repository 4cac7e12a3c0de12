"""Scalar fields on voxels and the predicates that label them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE, SINK, STRAY = 1, 2, 3
#: Cost of background; finite, so that paths may cross it.
BACKGROUND = 1e12


def normalised(dist: Column, most: Column) -> Column:
    """Distance over its maximum; 1 where the fragment has no background at all."""
    return F.when(most == float("inf"), F.lit(1.0)).when(most > 0, dist / most).otherwise(dist)


def power(c: Column, exponent: float) -> Column:
    """c ** exponent; small whole exponents as products, which are exact to the last bit everywhere."""
    return {0.0: F.lit(1.0), 1.0: c, 2.0: c * c}.get(float(exponent), F.pow(c, F.lit(float(exponent))))


def travel_cost(dn: Column, gamma: float = 1.6) -> Column:
    """1 / clip(dn ** gamma, 1e-6, 1): narrow necks are slow."""
    return 1.0 / F.least(F.greatest(power(dn, max(gamma, 0.0)), F.lit(1e-6)), F.lit(1.0))


def ridge_cost(dn: Column, exponent: float = 2.0, eps: float = 1e-6) -> Column:
    """1 / (eps + dn ** power): paths follow the ridge of the distance."""
    return 1.0 / (F.lit(eps) + power(F.least(F.greatest(dn, F.lit(0.0)), F.lit(1.0)), max(0.0, exponent)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def relative_difference(ta: Column, tb: Column) -> Column:
    return F.when(finite(ta) & finite(tb), F.abs(ta - tb) / (ta + tb + 1e-12)).otherwise(0.0)


def discounted(own: Column, other: Column, k: float = 2.0, decay: float = 1.0) -> Column:
    """A side's arrival, divided the more the closer the other side's seeds are."""
    return own / (1.0 + k * F.exp(-decay * F.greatest(other, F.lit(0.0))))


def in_band(ta: Column, tb: Column, width: float = 0.08) -> Column:
    return finite(ta) & finite(tb) & (relative_difference(ta, tb) <= width)


def in_volume() -> Column:
    """0 <= coordinate < size on every axis (columns z, y, x and nz, ny, nx)."""
    out = F.lit(True)
    for a in "zyx":
        out = out & (F.col(a) >= 0) & (F.col(a) < F.col(f"n{a}"))
    return out


def label_of(band: Column, ta: Column, tb: Column, k: float = 2.0, decay: float = 1.0) -> Column:
    """Within the band by discounted arrivals, outside by plain ones; ties go to the source."""
    inner = F.when(discounted(ta, tb, k, decay) <= discounted(tb, ta, k, decay), SOURCE).otherwise(SINK)
    return F.when(band, inner).when(ta <= tb, SOURCE).otherwise(SINK).cast("tinyint")
