"""Coordinate systems beyond WGS84 degrees and UTM: read from well-known text or from a code, converted by column expressions.

Projections: transverse Mercator, Lambert conformal conic with one or two standard parallels, Albers equal area, polar
stereographic by scale or by parallel, Mercator, and web Mercator; on any ellipsoid, in any unit, from any prime meridian. A datum
goes to WGS84 by its seven parameters, from the text or from a short list; datums that differ from WGS84 by no more than some
two metres are taken for it. Anything else is an error, not a guess. All formulas are closed: no iteration in an expression."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A step of a conversion: some columns to others.
Step = Callable[..., tuple[Column, ...]]

WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
# Published seven parameters to WGS84 (metres, seconds of arc, millionths) of datums by a part of their name.
SHIFTS = {
    "osgb": (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894),
    "ordnancesurvey": (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894),
    "european1950": (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0),
    "european_1950": (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0),
    "northamerican1927": (-8.0, 160.0, 176.0, 0.0, 0.0, 0.0, 0.0),
    "hauptdreiecksnetz": (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7),
    "pulkovo1942": (23.92, -141.27, -80.9, 0.0, 0.35, 0.82, -0.12),
    "tokyo": (-146.414, 507.337, 680.507, 0.0, 0.0, 0.0, 0.0),
    "australiangeodeticdatum1984": (-134.0, -48.0, 149.0, 0.0, 0.0, 0.0, 0.0),
    "southamericandatum1969": (-57.0, 1.0, -41.0, 0.0, 0.0, 0.0, 0.0),
}
#: Parts of the names of datums that are taken for WGS84.
SAME = ("wgs1984", "wgs84", "worldgeodeticsystem1984", "northamerican1983", "northamericandatum1983", "nad83", "etrs", "europeanterrestrial", "gda94", "gda2020", "geocentricdatumofaustralia", "newzealandgeodeticdatum2000", "nzgd2000", "sirgas", "rgf93", "reseaugeodesiquefrancais", "jgd2000", "japanesegeodeticdatum2000", "itrf", "csrs", "hartebeesthoek94")


@dataclass(frozen=True)
class System:
    """A coordinate system. kind is geographic or a projection; angles are degrees, offsets metres, unit is metres (degrees) a unit."""

    kind: str
    a: float = WGS84[0]
    inverse: float = WGS84[1]
    lat0: float = 0.0
    lon0: float = 0.0
    sp1: float | None = None
    sp2: float | None = None
    k0: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0
    prime: float = 0.0
    shift: tuple[float, ...] = ()

    @property
    def f(self) -> float:
        return 1 / self.inverse if self.inverse else 0.0

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))


# Well-known text


def _tree(text: str) -> list:
    """KEY["name", 1.0, KEY[...]] as [key, name, 1.0, [key, ...]]."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[A-Za-z_][A-Za-z0-9_]*|[-+0-9.][-+0-9.eE]*|[\[\](),]', text)
    at = 0

    def node() -> list:
        nonlocal at
        out: list = [tokens[at].upper()]
        at += 2
        while at < len(tokens) and tokens[at] not in "])":
            t = tokens[at]
            if t == ",":
                at += 1
            elif t[0] == '"':
                out.append(t[1:-1].replace('""', '"'))
                at += 1
            elif at + 1 < len(tokens) and tokens[at + 1] in "[(":
                out.append(node())
            else:
                out.append(float(t) if t[0] in "-+.0123456789" else t)
                at += 1
        at += 1
        return out

    return node()


def _find(tree: list, *keys: str) -> list | None:
    """The first node of a key, a node before its children."""
    own = [x for x in tree if isinstance(x, list)]
    return next((x for x in own if x[0] in keys), None) or next((y for x in own if (y := _find(x, *keys))), None)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


# Names of the projections' kinds and of their parameters, without blanks and marks.
KINDS = {
    "transversemercator": "tm", "gausskruger": "tm", "lambertconformalconic": "lcc", "lambertconformalconic1sp": "lcc", "lambertconformalconic2sp": "lcc", "lambertconicconformal1sp": "lcc", "lambertconicconformal2sp": "lcc",
    "albers": "albers", "albersconicequalarea": "albers", "albersequalarea": "albers", "polarstereographic": "polar", "polarstereographicvarianta": "polar", "polarstereographicvariantb": "polar", "stereographicnorthpole": "polar", "stereographicsouthpole": "polar",
    "mercator": "mercator", "mercator1sp": "mercator", "mercator2sp": "mercator", "mercatorvarianta": "mercator", "mercatorvariantb": "mercator", "mercatorauxiliarysphere": "web", "popularvisualisationpseudomercator": "web",
}
PARAMETERS = {
    "latitudeoforigin": "lat0", "latitudeofcenter": "lat0", "latitudeofnaturalorigin": "lat0", "latitudeoffalseorigin": "lat0", "centralmeridian": "lon0", "longitudeofcenter": "lon0", "longitudeoforigin": "lon0", "longitudeofnaturalorigin": "lon0", "longitudeoffalseorigin": "lon0", "straightverticallongitudefrompole": "lon0",
    "standardparallel1": "sp1", "latitudeof1ststandardparallel": "sp1", "latitudeofstandardparallel": "sp1", "standardparallel2": "sp2", "latitudeof2ndstandardparallel": "sp2", "scalefactor": "k0", "scalefactoratnaturalorigin": "k0",
    "falseeasting": "east", "eastingatfalseorigin": "east", "falsenorthing": "north", "northingatfalseorigin": "north",
}


def _datum(tree: list) -> tuple[float, float, tuple[float, ...]]:
    datum = _find(tree, "DATUM", "ENSEMBLE", "GEODETICDATUM") or []
    ball = _find(tree, "SPHEROID", "ELLIPSOID")
    if ball is None:
        raise ValueError("a coordinate system without an ellipsoid is not supported")
    name = _plain(str(datum[1])) if len(datum) > 1 else ""
    given = _find(tree, "TOWGS84")
    if given:
        shift = tuple(float(x) for x in given[1:8])
        shift += (0.0,) * (7 - len(shift))
    elif any(s in name for s in SAME):
        shift = ()
    else:
        shift = next((v for k, v in SHIFTS.items() if k.replace("_", "") in name), None)
        if shift is None:
            raise ValueError(f"datum {datum[1] if len(datum) > 1 else ''} is not supported")
    return float(ball[2]), float(ball[3]), shift if any(shift) else ()


@lru_cache(maxsize=256)
def parse(text: str) -> System:
    """The system of an EPSG code or of well-known text; what is not supported is an error."""
    text = text.strip()
    if m := re.fullmatch(r"EPSG:(\d+)", text, re.IGNORECASE):
        return of_code(int(m[1]))
    tree = _tree(text)
    if tree[0] in ("COMPD_CS", "COMPOUNDCRS", "BOUNDCRS"):
        tree = _find(tree, "PROJCS", "PROJCRS", "GEOGCS", "GEOGCRS") or tree
    a, inverse, shift = _datum(tree)
    prime = _find(tree, "PRIMEM")
    prime_degrees = float(prime[2]) if prime else 0.0
    if tree[0] in ("GEOGCS", "GEOGCRS", "GEODCRS"):
        unit = _find(tree, "UNIT", "ANGLEUNIT")
        return System("geographic", a, inverse, unit=math.degrees(float(unit[2])) if unit else 1.0, prime=prime_degrees, shift=shift)
    if tree[0] not in ("PROJCS", "PROJCRS"):
        raise ValueError(f"coordinate system {text[:60]} is not supported")
    method = _find(tree, "PROJECTION", "METHOD")
    name = _plain(str(method[1])) if method else ""
    if name not in KINDS:
        raise ValueError(f"projection {method[1] if method else text[:60]} is not supported")
    kind = KINDS[name]
    own_unit = next((x for x in reversed(tree) if isinstance(x, list) and x[0] in ("UNIT", "LENGTHUNIT")), None) or _find(next((x for x in tree if isinstance(x, list) and x[0] == "CS"), tree), "LENGTHUNIT")
    unit = float(own_unit[2]) if own_unit else 1.0
    base = _find(tree, "GEOGCS", "BASEGEOGCRS", "BASEGEODCRS") or tree
    angle = _find(base, "UNIT", "ANGLEUNIT")
    degrees = math.degrees(float(angle[2])) if angle else 1.0
    values: dict[str, float] = {}
    for p in _parameters(tree):
        key = PARAMETERS.get(_plain(str(p[1])))
        if key:
            turn = next((math.degrees(float(x[2])) for x in p[3:] if isinstance(x, list) and x[0] == "ANGLEUNIT"), degrees)
            long = next((float(x[2]) for x in p[3:] if isinstance(x, list) and x[0] == "LENGTHUNIT"), unit)
            values[key] = float(p[2]) * (1.0 if key == "k0" else long if key in ("east", "north") else turn)
    whole = _find(tree, "EXTENSION")
    if kind == "mercator" and ("pseudomercator" in _plain(str(tree[1])) or whole is not None and "+b=6378137" in str(whole[-1])):
        kind = "web"
    if kind == "polar" and abs(abs(values.get("lat0", 90.0)) - 90) > 1e-9 and "sp1" not in values:
        values["sp1"] = values["lat0"]  # the parallel of true scale stands in the origin's place
    if kind == "polar":
        values["lat0"] = math.copysign(90.0, values.get("sp1", -90.0 if "south" in name else values.get("lat0", 90.0)))
    return System(kind, a, inverse, unit=unit, prime=prime_degrees * (degrees if abs(degrees - 1) > 1e-9 else 1.0), shift=shift, **values)


def _parameters(tree: list) -> list:
    out = [x for x in tree if isinstance(x, list) and x[0] == "PARAMETER"]
    return out + [p for x in tree if isinstance(x, list) and x[0] == "CONVERSION" for p in _parameters(x)]


# Systems by EPSG code, beside the UTM zones.
CODES = {
    3857: System("web"),
    3395: System("mercator"),
    5070: System("albers", *GRS80, lat0=23.0, lon0=-96.0, sp1=29.5, sp2=45.5),
    3005: System("albers", *GRS80, lat0=45.0, lon0=-126.0, sp1=50.0, sp2=58.5, east=1_000_000.0),
    3577: System("albers", *GRS80, lat0=0.0, lon0=132.0, sp1=-18.0, sp2=-36.0),
    3338: System("albers", *GRS80, lat0=50.0, lon0=-154.0, sp1=55.0, sp2=65.0),
    3347: System("lcc", *GRS80, lat0=63.390675, lon0=-91.8666666666667, sp1=49.0, sp2=77.0, east=6_200_000.0, north=3_000_000.0),
    2154: System("lcc", *GRS80, lat0=46.5, lon0=3.0, sp1=49.0, sp2=44.0, east=700_000.0, north=6_600_000.0),
    3034: System("lcc", *GRS80, lat0=52.0, lon0=10.0, sp1=35.0, sp2=65.0, east=4_000_000.0, north=2_800_000.0),
    3413: System("polar", lat0=90.0, lon0=-45.0, sp1=70.0),
    3031: System("polar", lat0=-90.0, lon0=0.0, sp1=-71.0),
    3995: System("polar", lat0=90.0, lon0=0.0, sp1=71.0),
    5041: System("polar", lat0=90.0, k0=0.994, east=2_000_000.0, north=2_000_000.0),
    5042: System("polar", lat0=-90.0, k0=0.994, east=2_000_000.0, north=2_000_000.0),
    27700: System("tm", 6377563.396, 299.3249646, lat0=49.0, lon0=-2.0, k0=0.9996012717, east=400_000.0, north=-100_000.0, shift=SHIFTS["osgb"]),
}


def of_code(epsg: int) -> System:
    """Known codes, degrees of WGS84 and of what is taken for it, and UTM zones on WGS84, NAD83, ETRS89 and GDA94."""
    if epsg in CODES:
        return CODES[epsg]
    if epsg in (4326, 4269, 4258, 4283, 7844, 4167, 4674):
        return System("geographic", *(WGS84 if epsg == 4326 else GRS80))
    zone = epsg % 100
    for first, last, series, ball, south in ((1, 60, 326, WGS84, False), (1, 60, 327, WGS84, True), (1, 23, 269, GRS80, False), (28, 38, 258, GRS80, False), (48, 58, 283, GRS80, True)):
        if epsg // 100 == series and first <= zone <= last:
            return System("tm", *ball, lon0=zone * 6 - 183.0, k0=0.9996, east=500_000.0, north=10_000_000.0 if south else 0.0)
    raise ValueError(f"EPSG:{epsg} is not supported")


# Expressions; angles in radians


def _series(x: Column, terms: tuple[float, ...]) -> Column:
    return x + sum((c * F.sin(2 * j * x) for j, c in enumerate(terms, 1)), F.lit(0.0))


def _latitude(s: System, t: Column) -> Column:
    """The latitude of an isometric t = tan(pi / 4 - conformal latitude / 2)."""
    e2 = s.e**2
    chi = math.pi / 2 - 2 * F.atan(t)
    return _series(chi, (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280))


def _t(s: System, lat: Column) -> Column:
    e, sin = s.e, F.sin(lat)
    return F.tan(math.pi / 4 - lat / 2) / F.pow((1 - e * sin) / (1 + e * sin), F.lit(e / 2))


def _t_of(s: System, degrees: float) -> float:
    lat = math.radians(degrees)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s.e * math.sin(lat)) / (1 + s.e * math.sin(lat))) ** (s.e / 2)


def _m_of(s: System, degrees: float) -> float:
    lat = math.radians(degrees)
    return math.cos(lat) / math.sqrt(1 - (s.e * math.sin(lat)) ** 2)


def _cone(s: System) -> tuple[float, float, float]:
    """Exponent, factor and the radius of the origin's parallel, of a conformal cone."""
    one = s.lat0 if s.sp1 is None else s.sp1
    two = one if s.sp2 is None else s.sp2
    if abs(one - two) < 1e-12:
        n = math.sin(math.radians(one))
    else:
        n = (math.log(_m_of(s, one)) - math.log(_m_of(s, two))) / (math.log(_t_of(s, one)) - math.log(_t_of(s, two)))
    factor = s.a * s.k0 * _m_of(s, one) / (n * _t_of(s, one) ** n)
    return n, factor, factor * _t_of(s, s.lat0) ** n


def _area(s: System, sin):
    """The authalic function of a sine of latitude, a number or a column."""
    e = s.e
    log = F.log if isinstance(sin, Column) else math.log
    return (1 - e * e) * (sin / (1 - e * e * sin * sin) - log((1 - e * sin) / (1 + e * sin)) / (2 * e))


def _albers(s: System) -> tuple[float, float, float]:
    one, two = s.sp1, s.sp1 if s.sp2 is None else s.sp2
    q1, q2, q0 = (_area(s, math.sin(math.radians(x))) for x in (one, two, s.lat0))
    n = math.sin(math.radians(one)) if abs(one - two) < 1e-12 else (_m_of(s, one) ** 2 - _m_of(s, two) ** 2) / (q2 - q1)
    c = _m_of(s, one) ** 2 + n * q1
    return n, c, s.a * math.sqrt(c - n * q0) / n


def _pole(s: System) -> float:
    """Radius by t of a polar stereographic plane."""
    if s.sp1 is not None:
        return s.a * _m_of(s, abs(s.sp1)) / _t_of(s, abs(s.sp1))
    return 2 * s.a * s.k0 / math.sqrt((1 + s.e) ** (1 + s.e) * (1 - s.e) ** (1 - s.e))


def _mercator(s: System) -> float:
    return s.a * (s.k0 if s.sp1 is None else _m_of(s, s.sp1))


def _transverse(s: System) -> tuple[float, tuple, tuple, float]:
    """Radius, the series there and back, and the origin's place along the meridian."""
    n = s.f / (2 - s.f)
    radius = s.k0 * s.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    chi = math.pi / 2 - 2 * math.atan(_t_of(s, s.lat0))
    origin = chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(alpha, 1))
    return radius, alpha, beta, radius * origin


def _wrap(angle: Column) -> Column:
    """Between -pi and pi."""
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def _project(s: System) -> list[Step]:
    """From the system's own longitude and latitude in radians to x and y in its units."""
    out = lambda x, y: ((x + s.east) / s.unit, (y + s.north) / s.unit)
    turned = lambda lon: _wrap(lon - math.radians(s.lon0))
    if s.kind == "lcc":
        n, factor, r0 = _cone(s)
        return [lambda lon, lat: (n * turned(lon), factor * F.pow(_t(s, lat), F.lit(n))), lambda d, r: out(r * F.sin(d), r0 - r * F.cos(d))]
    if s.kind == "albers":
        n, c, r0 = _albers(s)
        return [lambda lon, lat: (n * turned(lon), s.a * F.sqrt(F.greatest(c - n * _area(s, F.sin(lat)), F.lit(0.0))) / n), lambda d, r: out(r * F.sin(d), r0 - r * F.cos(d))]
    if s.kind == "polar":
        side, factor = math.copysign(1.0, s.lat0), _pole(s)
        return [lambda lon, lat: (turned(lon), factor * _t(s, side * lat)), lambda d, r: out(r * F.sin(d), -side * r * F.cos(d))]
    if s.kind == "web":
        return [lambda lon, lat: out(s.a * turned(lon), s.a * F.log(F.tan(math.pi / 4 + lat / 2)))]
    if s.kind == "mercator":
        r0 = _mercator(s)
        return [lambda lon, lat: out(r0 * turned(lon), -r0 * F.log(_t(s, lat)))]
    radius, alpha, _, origin = _transverse(s)
    return [
        lambda lon, lat: (turned(lon), F.sin(lat)),
        lambda d, sin: (d, F.sinh(F.atanh(sin) - s.e * F.atanh(s.e * sin))),
        lambda d, iso: (F.atan2(iso, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + iso * iso))),
        lambda xi, eta: out(radius * (eta + _terms(alpha, xi, eta, F.cos, F.sinh)), radius * (xi + _terms(alpha, xi, eta, F.sin, F.cosh)) - origin),
    ]


def _terms(series: tuple[float, ...], xi: Column, eta: Column, f, g) -> Column:
    return sum((c * f(2 * j * xi) * g(2 * j * eta) for j, c in enumerate(series, 1)), F.lit(0.0))


def _unproject(s: System) -> list[Step]:
    """From x and y in the system's units to its own longitude and latitude in radians."""
    plane = lambda x, y: (x * s.unit - s.east, y * s.unit - s.north)
    lon0 = math.radians(s.lon0)
    if s.kind in ("lcc", "albers"):
        n, c, r0 = _cone(s) if s.kind == "lcc" else _albers(s)
        side = math.copysign(1.0, n)
        polar = lambda x, y: (F.atan2(side * x, side * (r0 - y)) / n, F.sqrt(x * x + (r0 - y) * (r0 - y)))
        if s.kind == "lcc":
            return [plane, polar, lambda d, r: (d + lon0, _latitude(s, F.pow(r / abs(c), F.lit(1 / n))))]
        e2 = s.e**2
        whole = _area(s, 1.0)
        terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
        q = lambda r: (c - (r * n / s.a) * (r * n / s.a)) / n / whole
        return [plane, polar, lambda d, r: (d + lon0, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q(r))))), lambda lon, beta: (lon, _series(beta, terms))]
    if s.kind == "polar":
        side, factor = math.copysign(1.0, s.lat0), _pole(s)
        return [plane, lambda x, y: (F.atan2(x, -side * y) + lon0, side * _latitude(s, F.sqrt(x * x + y * y) / factor))]
    if s.kind == "web":
        return [plane, lambda x, y: (x / s.a + lon0, math.pi / 2 - 2 * F.atan(F.exp(-y / s.a)))]
    if s.kind == "mercator":
        r0 = _mercator(s)
        return [plane, lambda x, y: (x / r0 + lon0, _latitude(s, F.exp(-y / r0)))]
    radius, _, beta, origin = _transverse(s)
    return [
        plane,
        lambda x, y: ((y + origin) / radius, x / radius),
        lambda xi, eta: (xi - _terms(beta, xi, eta, F.sin, F.cosh), eta - _terms(beta, xi, eta, F.cos, F.sinh)),
        lambda a, b: (F.atan2(F.sinh(b), F.cos(a)) + lon0, F.tan(math.pi / 4 - F.asin(F.sin(a) / F.cosh(b)) / 2)),
        lambda lon, t: (lon, _latitude(s, t)),
    ]


def _geocentric(a: float, e2: float) -> Step:
    def step(lon: Column, lat: Column) -> tuple[Column, ...]:
        n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
        return n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)

    return step


def _geodetic(a: float, f: float) -> list[Step]:
    """Longitude and latitude, by Bowring's closed formula."""
    e2, b = f * (2 - f), a * (1 - f)
    second = e2 / (1 - e2)
    return [
        lambda x, y, z: (F.atan2(y, x), F.sqrt(x * x + y * y), z),
        lambda lon, p, z: (lon, p, z, F.atan2(z * a, p * b)),
        lambda lon, p, z, turn: (lon, F.atan2(z + second * b * F.pow(F.sin(turn), 3), p - e2 * a * F.pow(F.cos(turn), 3))),
    ]


def _shift(s: System, back: bool) -> list[Step]:
    """From a datum's longitude and latitude to WGS84's, or back, by position vectors."""
    if not s.shift:
        return []
    dx, dy, dz = s.shift[:3]
    rx, ry, rz = (math.radians(v / 3600) for v in s.shift[3:6])
    k, f84 = 1 + s.shift[6] / 1e6, 1 / WGS84[1]
    if back:
        return [
            _geocentric(WGS84[0], f84 * (2 - f84)),
            lambda x, y, z: ((x - dx) / k, (y - dy) / k, (z - dz) / k),
            lambda x, y, z: (x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z),
            *_geodetic(s.a, s.f),
        ]
    return [_geocentric(s.a, s.e**2), lambda x, y, z: (dx + k * (x - rz * y + ry * z), dy + k * (rz * x + y - rx * z), dz + k * (-ry * x + rx * y + z)), *_geodetic(WGS84[0], f84)]


def _run(steps: list[Step], x: Column, y: Column) -> tuple[Column, Column]:
    """The steps one after the other. Each names its inputs once, so that an expression grows with the number of steps and not
    with its power."""
    if len(steps) == 1:
        return steps[0](x, y)
    bound, sizes = F.array(F.struct(x.alias("v0"), y.alias("v1"))), [2]

    def bind(step: Step) -> Callable[[Column], Column]:
        def one(v: Column) -> Column:
            out = step(*[v[f"v{i}"] for i in range(sizes[-1])])
            sizes.append(len(out))
            return F.struct(*[c.alias(f"v{i}") for i, c in enumerate(out)])

        return one

    for step in steps:
        bound = F.transform(bound, bind(step))
    first = F.get(bound, F.lit(0))
    return first["v0"], first["v1"]


def _to(s: System) -> list[Step]:
    own = [lambda x, y: (F.radians(x * s.unit), F.radians(y * s.unit))] if s.kind == "geographic" else _unproject(s)
    prime = [lambda lon, lat: (lon + math.radians(s.prime), lat)] if s.prime else []
    return [*own, *prime, *_shift(s, False), lambda lon, lat: (F.degrees(lon), F.degrees(lat))]


def _of(s: System) -> list[Step]:
    prime = [lambda lon, lat: (lon - math.radians(s.prime), lat)] if s.prime else []
    own = [lambda lon, lat: (F.degrees(lon) / s.unit, F.degrees(lat) / s.unit)] if s.kind == "geographic" else _project(s)
    return [lambda lon, lat: (F.radians(lon), F.radians(lat)), *_shift(s, True), *prime, *own]


def to_degrees(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude on WGS84, in degrees."""
    return _run(_to(s), x, y)


def of_degrees(s: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y of longitudes and latitudes on WGS84."""
    return _run(_of(s), lon, lat)


def between(source: System, target: System, x: Column, y: Column) -> tuple[Column, Column]:
    return _run([*_to(source), *_of(target)], x, y)
