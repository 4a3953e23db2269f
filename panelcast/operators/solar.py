"""Solar geometry and irradiance features per site and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def sun_position(df: DataFrame, lat: Column | str = "lat", lon: Column | str = "lon") -> DataFrame:
    """Adds zenith, elevation and azimuth in degrees (about 0.3 degrees accurate), the
    cosine of the zenith and relative airmass.

    Shared terms are columns of their own, so the planner evaluates each once.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    ts, gamma, decl, ha, phi = (F.col(c) for c in ("ts", "_gamma", "_decl", "_ha", "_phi"))
    return (
        df.withColumns({"_gamma": C.year_angle(ts), "_phi": F.radians(col(lat))})
        .withColumns({"_decl": C.declination(gamma), "_ha": C.hour_angle(ts, gamma, col(lon))})
        .withColumn("cos_zenith", C.cos_zenith(phi, decl, ha))
        .withColumn("sun_zenith", F.degrees(F.acos("cos_zenith")))
        .withColumns({"sun_elev": 90.0 - F.col("sun_zenith"), "sun_az": C.sun_azimuth(phi, decl, ha)})
        .withColumn("airmass", C.airmass(F.col("sun_zenith")))
        .drop("_gamma", "_decl", "_ha", "_phi")
    )


def irradiance(
    df: DataFrame,
    ghi: str = "shortwave_radiation",
    dni: str = "direct_normal_irradiance",
    tilt: Column | str = "tilt",
    facing: Column | str = "azimuth",
    albedo: float = 0.25,
) -> DataFrame:
    """Adds extraterrestrial, clearness, incidence and plane-of-array columns."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    aoi = C.incidence(F.col("sun_zenith"), F.col("sun_az"), col(tilt), col(facing))
    return (
        df.withColumn("dni_extra", C.extraterrestrial(F.col("ts")))
        .withColumn("ghi_toa_horiz", F.col("dni_extra") * F.greatest("cos_zenith", F.lit(0.0)))
        .withColumn("clearness_kt", C.clearness(F.col(ghi), F.col("ghi_toa_horiz")))
        .withColumn("aoi", F.coalesce(aoi, F.lit(90.0)))
        .withColumn("cos_aoi", F.greatest(F.cos(F.radians("aoi")), F.lit(0.0)))
        .withColumn(
            "poa_global",
            F.coalesce(
                C.plane_irradiance(
                    F.col(ghi), F.col(dni), F.col("cos_zenith"), F.col("cos_aoi"), col(tilt), albedo
                ),
                F.lit(0.0),
            ),
        )
    )
