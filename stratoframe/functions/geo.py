"""Geography and calendar as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def longitude(value: Column) -> Column:
    """Normalised to [0, 360); the remainder operator would keep the sign."""
    return F.pmod(value, F.lit(360.0))


def xyz(latitude: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere."""
    lat, lon = F.radians(latitude), F.radians(lon)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def chord(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def chord_of_km(km: float) -> float:
    """Straight distance on the unit sphere of points so far apart along the surface."""
    return 2 * math.sin(min(km / EARTH_KM, math.pi) / 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def box_area_km2(north: float, west: float, south: float, east: float) -> float:
    return EARTH_KM**2 * abs(math.sin(math.radians(north)) - math.sin(math.radians(south))) * math.radians((east - west) % 360 or 360)


def inside(latitude: Column, lon: Column, north: float, west: float, south: float, east: float) -> Column:
    """In the box; it wraps around the globe where its west lies east of its east."""
    w, e, x = west % 360, east % 360, longitude(lon)
    whole = abs(east - west) >= 360
    across = F.lit(True) if whole else ((x >= w) & (x <= e)) if w <= e else ((x >= w) | (x <= e))
    return latitude.between(south, north) & across


def days_of_year(at: Column) -> Column:
    """Fractional days since the year's first instant."""
    return F.dayofyear(at) - 1 + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / 86400


def declination(at: Column) -> Column:
    """Of the sun, in radians: a documented approximation (Cooper's formula)."""
    return F.radians(F.lit(23.45)) * F.sin(2 * math.pi * (F.lit(284.0) + days_of_year(at) + 1) / 365.0)


def forcing(name: str, at: Column, latitude: Column, lon: Column) -> Column:
    """A computed forcing by name, for example cos_latitude or sin_julian_day; the sun's position is an approximation."""
    local = F.pmod(F.hour(at) + F.minute(at) / 60 + F.second(at) / 3600 + lon / 360 * 24, F.lit(24.0))
    angles = {
        "latitude": F.radians(latitude),
        "longitude": F.radians(lon),
        "julian_day": days_of_year(at) / 365.25 * 2 * math.pi,
        "local_time": local / 24 * 2 * math.pi,
    }
    if name[:4] in ("cos_", "sin_") and name[4:] in angles:
        return (F.cos if name.startswith("cos") else F.sin)(angles[name[4:]])
    x, y, z = xyz(latitude, lon)
    plain = {"ecef_x": x, "ecef_y": y, "ecef_z": z, "latitude": latitude, "longitude": lon}
    if name in plain:
        return plain[name]
    hour_angle = (local - 12) / 24 * 2 * math.pi
    sun = F.sin(F.radians(latitude)) * F.sin(declination(at)) + F.cos(F.radians(latitude)) * F.cos(declination(at)) * F.cos(hour_angle)
    if name in ("insolation", "cos_solar_zenith_angle"):
        return F.greatest(sun, F.lit(0.0))
    if name == "toa_incident_solar_radiation":
        return 1361.0 * (1 + 0.033 * F.cos(2 * math.pi * (days_of_year(at) + 1) / 365.0)) * F.greatest(sun, F.lit(0.0)) * 3600
    raise ValueError(f"unknown forcing: {name!r}")
