"""Coordinate systems by code or text, and UTM on WGS84 by Krueger's series to the third order of the flattening."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import projections

# The WGS84 ellipsoid and the UTM scale and offsets.
A, FLAT, K0, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLAT / (2 - FLAT)
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def zone(epsg: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing of EPSG 326xx and 327xx; others are an error."""
    z = epsg % 100
    if epsg // 100 not in (326, 327) or not 1 <= z <= 60:
        raise ValueError(f"EPSG:{epsg} is not a UTM zone on WGS84")
    return z * 6 - 183.0, SOUTH if epsg // 100 == 327 else 0.0


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    meridian, north = zone(epsg)
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lon - meridian)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + K0 * _R * x, north + K0 * _R * y


def to_wgs84(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    meridian, north = zone(epsg)
    xi, eta = (y - north) / (K0 * _R), (x - EAST) / (K0 * _R)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, k in enumerate(_DELTA, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def looks_geographic(x: Column, y: Column) -> Column:
    return (F.abs(x) <= 360) & (F.abs(y) <= 90)


def of_wkt(text: str | None) -> str | None:
    """The system of a .prj file's text, as `convert` takes it: an EPSG code where it is WGS84 longitudes and latitudes or a UTM
    zone on WGS84, else the text; None without a text that names a system. What is not supported is an error."""
    text = (text or "").strip()
    if not text.startswith(("GEOGCS", "GEOGCRS", "GEODCRS", "PROJCS", "PROJCRS", "COMPD_CS", "COMPOUNDCRS")):
        return None
    m = re.search(r"UTM[_ ]zone[_ ](\d{1,2})([NS])", text, re.IGNORECASE)
    code = f"EPSG:{326 if m[2].upper() == 'N' else 327}{int(m[1]):02}" if m else None
    if not re.search("SPHEROID|ELLIPSOID", text) and re.search(r"WGS[_ ]*(19)?84", text):  # names alone
        if text.startswith("GEOG"):
            return "EPSG:4326"
        if code:
            return code
    system = projections.parse(text)
    if system.kind == "geographic" and not system.shift and not system.prime and abs(system.unit - 1) < 1e-9 and (system.a, system.inverse) == projections.WGS84:
        return "EPSG:4326"
    if code and system.kind == "tm" and not system.shift:
        known = projections.parse(code)
        if all(abs(a - b) < 1e-9 * max(1.0, abs(b)) for a, b in zip(_numbers(system), _numbers(known), strict=True)):
            return code
    return text


def _numbers(s: projections.System) -> list[float]:
    return [s.a, s.inverse, s.lat0, s.lon0, s.k0, s.east, s.north, s.unit, s.prime]


def convert(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one system, an EPSG code or well-known text, in another, by way of WGS84."""
    if source == target or not source or not target:
        return x, y
    utm = re.compile(r"EPSG:32[67]\d\d")
    if all(c == "EPSG:4326" or utm.fullmatch(c) for c in (source, target)):  # plain expressions, compiled
        lon, lat = (x, y) if source == "EPSG:4326" else to_wgs84(x, y, int(source[5:]))
        return (lon, lat) if target == "EPSG:4326" else to_utm(lon, lat, int(target[5:]))
    return projections.between(projections.parse(source), projections.parse(target), x, y)
