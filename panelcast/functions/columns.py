"""Scalar column expressions: calendar, cyclic, solar geometry, ratios, bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import Grid, epoch_seconds, season_slot


def calendar(ts: Column, slot: Column, grid: Grid) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "month": F.month(ts),
        "doy": F.dayofyear(ts),
        "dow": F.weekday(ts),
        "season_slot": season_slot(slot, grid),
    }


def finite(*values: Column) -> Column:
    """True where all are numbers: neither NULL nor NaN nor infinite (NaN is above infinity here)."""
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))
    return out


def cyclic(value: Column, period: float, name: str) -> dict[str, Column]:
    angle = value * F.lit(2.0 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def ratio(y: Column, capacity: Column, driver: Column, bound: float | Column | None = 1.5) -> Column:
    """``y`` over the envelope ``max(capacity * driver / 1000, 1)``, kept in [0, bound].

    ``None`` or an infinite bound leaves the upper side open. NULL ``y`` stays NULL.
    """
    raw = y / envelope(capacity, driver)
    low = F.when(raw < 0, F.lit(0.0)).otherwise(raw)
    if bound is None or (isinstance(bound, float) and math.isinf(bound)):
        return low
    top = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(low > top, top).otherwise(low)


def envelope(capacity: Column, driver: Column) -> Column:
    return F.greatest(capacity * driver / 1000.0, F.lit(1.0))


# Coefficients of Spencer's (1971) Fourier series for declination
# (radians), equation of time (minutes, scaled by 229.18) and the squared
# Earth-Sun distance ratio, and of the Kasten-Young (1989) airmass formula.
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
TIME_EQUATION = (0.000075, 0.001868, -0.032077, -0.014615, -0.04089)
DISTANCE = (1.00011, 0.034221, 0.00128, 0.000719, 0.000077)
SOLAR_CONSTANT = 1366.1
AIRMASS = (0.50572, 96.07995, -1.6364)


def _series(coef: Sequence[float], angle: Column) -> Column:
    out = F.lit(coef[0])
    for i, c in enumerate(coef[1:]):
        k = float(i // 2 + 1)
        out = out + F.lit(c) * (F.cos(angle * k) if i % 2 == 0 else F.sin(angle * k))
    return out


def year_angle(ts: Column) -> Column:
    """Fraction of the year as an angle, in radians."""
    hours = F.pmod(epoch_seconds(ts), F.lit(86400)) / 3600.0
    return F.lit(2.0 * math.pi / 365.0) * (F.dayofyear(ts) - 1 + (hours - 12.0) / 24.0)


def declination(gamma: Column) -> Column:
    return _series(DECLINATION, gamma)


def hour_angle(ts: Column, gamma: Column, lon: Column) -> Column:
    minutes = F.pmod(epoch_seconds(ts), F.lit(86400)) / 60.0
    true_time = minutes + F.lit(229.18) * _series(TIME_EQUATION, gamma) + lon * 4.0
    return F.radians(true_time / 4.0 - 180.0)


def cos_zenith(phi: Column, decl: Column, ha: Column) -> Column:
    raw = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(ha)
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0))


def sun_azimuth(phi: Column, decl: Column, ha: Column) -> Column:
    return F.degrees(F.atan2(F.sin(ha), F.cos(ha) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180.0


def airmass(zenith: Column) -> Column:
    a, b, c = AIRMASS
    return F.when(
        zenith < 90.0,
        1.0 / (F.cos(F.radians(zenith)) + a * F.pow(F.lit(b) - zenith, F.lit(c))),
    ).otherwise(40.0)


def extraterrestrial(ts: Column) -> Column:
    angle = F.lit(2.0 * math.pi / 365.0) * (F.dayofyear(ts) - 1)
    return F.lit(SOLAR_CONSTANT) * _series(DISTANCE, angle)


def clearness(driver: Column, toa: Column) -> Column:
    raw = F.when(toa > 50.0, driver / F.greatest(toa, F.lit(1.0))).otherwise(0.0)
    return F.greatest(F.least(raw, F.lit(1.5)), F.lit(0.0))


def incidence(zenith: Column, azimuth: Column, tilt: Column, facing: Column) -> Column:
    """Angle between the sun and the normal of a tilted plane, degrees."""
    z, t = F.radians(zenith), F.radians(tilt)
    proj = F.cos(t) * F.cos(z) + F.sin(t) * F.sin(z) * F.cos(F.radians(azimuth - facing))
    return F.degrees(F.acos(F.greatest(F.least(proj, F.lit(1.0)), F.lit(-1.0))))


def plane_irradiance(
    ghi: Column, dni: Column, cos_zenith: Column, cos_incidence: Column, tilt: Column, albedo: float = 0.25
) -> Column:
    """Beam, isotropic sky and ground-reflected parts on a tilted plane."""
    dhi = F.greatest(ghi - dni * F.greatest(cos_zenith, F.lit(0.0)), F.lit(0.0))
    cos_tilt = F.cos(F.radians(tilt))
    beam = F.greatest(dni * cos_incidence, F.lit(0.0))
    return beam + dhi * (1.0 + cos_tilt) / 2.0 + ghi * albedo * (1.0 - cos_tilt) / 2.0


def labelled_bins(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with labels; outside the edges NULL."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), F.lit(name)).otherwise(out)
    return out


def equal_bins(x: Column, lo: float, hi: float, n: int) -> Column:
    """Number 1..n of the right-closed bin of equal width; outside NULL."""
    return F.when(
        (x > lo) & (x <= hi), F.ceil((x - lo) * (n / (hi - lo))).cast("int")
    )
