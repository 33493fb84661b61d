"""Sun position as column expressions (low-precision almanac formulas, geometric altitude, no refraction)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the almanac formulas
JD_UNIX_EPOCH = 2440587.5
JD_J2000 = 2451545.0
SUNRISE_DEG = -0.833


def days_since_2000(unix_seconds: Column) -> Column:
    return unix_seconds / 86400.0 + JD_UNIX_EPOCH - JD_J2000


def sun_position(lat_deg: float, lon_deg: float, unix_seconds: Column) -> tuple[Column, Column]:
    """(elevation, azimuth) in degrees; azimuth clockwise from north."""
    n = days_since_2000(unix_seconds)
    mean_lon = F.radians(F.pmod(280.460 + 0.9856474 * n, F.lit(360.0)))
    anomaly = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    ecliptic = mean_lon + F.radians(F.lit(1.915)) * F.sin(anomaly) + F.radians(F.lit(0.020)) * F.sin(2.0 * anomaly)
    tilt = F.radians(23.439 - 3.6e-7 * n)
    right_asc = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    decl = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.pmod(18.697374558 + 24.06570982441908 * n, F.lit(24.0))
    hour = F.radians(F.pmod(sidereal * 15.0 + lon_deg - F.degrees(right_asc) + 180.0, F.lit(360.0)) - 180.0)
    lat = F.radians(F.lit(lat_deg))
    up = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(hour)
    elevation = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))
    azimuth = F.pmod(F.degrees(F.atan2(-F.cos(decl) * F.sin(hour), F.cos(lat) * F.sin(decl) - F.sin(lat) * F.cos(decl) * F.cos(hour))), F.lit(360.0))
    return elevation, azimuth


def sun_sql(lat: float, lon: float, source: str, seconds: str) -> str:
    """``source`` with columns elevation and azimuth added, as a chain of SQL subqueries for the comparison engine."""
    return f"""(SELECT *, degrees(asin(greatest(-1.0, least(1.0, sin(la) * sin(decl) + cos(la) * cos(decl) * cos(hour))))) AS elevation,
      (degrees(atan2(-cos(decl) * sin(hour), cos(la) * sin(decl) - sin(la) * cos(decl) * cos(hour))) + 360.0) % 360.0 AS azimuth FROM
      (SELECT *, radians(CAST({lat} AS DOUBLE)) AS la, radians(((((18.697374558 + 24.06570982441908 * n) % 24.0) * 15.0 + {lon} - degrees(ra) + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) AS hour FROM
      (SELECT *, atan2(cos(tilt) * sin(ecl), cos(ecl)) AS ra, asin(sin(tilt) * sin(ecl)) AS decl FROM
      (SELECT *, radians((280.460 + 0.9856474 * n) % 360.0) + radians(1.915) * sin(radians((357.528 + 0.9856003 * n) % 360.0))
        + radians(0.020) * sin(2.0 * radians((357.528 + 0.9856003 * n) % 360.0)) AS ecl, radians(23.439 - 3.6e-7 * n) AS tilt FROM
      (SELECT *, CAST({seconds} AS DOUBLE) / 86400.0 + 2440587.5 - 2451545.0 AS n FROM {source})))))"""
