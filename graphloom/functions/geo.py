"""Geographic shapes and predicates.

A shape of a condition is a Geoshape held by the program. A property that is a point is a struct<lat, lon> and is tested by native expressions, whatever the
condition's shape; a property of any other shape is its WKT text and is tested by a vectorised function. All tests are false on null.
Distances are great-circle kilometres on the mean earth radius.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.predicates import P

EARTH_KM = 6371.0087714


@dataclass(frozen=True)
class Geoshape:
    """kind: point, circle, box, line, polygon, multi (of parts). coords are (lat, lon); a box has its south-west and north-east corners."""

    kind: str
    coords: tuple[tuple[float, float], ...] = ()
    radius_km: float = 0.0
    parts: tuple[Geoshape, ...] = ()

    def wkt(self) -> str:
        xy = lambda cs: ", ".join(f"{lon:g} {lat:g}" for lat, lon in cs)
        if self.kind == "point":
            return f"POINT ({xy(self.coords)})"
        if self.kind == "circle":
            return f"BUFFER (POINT ({xy(self.coords)}), {self.radius_km:g})"
        if self.kind == "box":
            (s, w), (n, e) = self.coords
            return f"ENVELOPE ({w:g}, {e:g}, {n:g}, {s:g})"
        if self.kind == "line":
            return f"LINESTRING ({xy(self.coords)})"
        if self.kind == "polygon":
            return f"POLYGON (({xy(self.coords)}))"
        return "GEOMETRYCOLLECTION (" + ", ".join(p.wkt() for p in self.parts) + ")"

    def geojson(self) -> str:
        """Coordinates are (longitude, latitude), as GeoJSON has them."""
        at = [[lon, lat] for lat, lon in self.coords]
        if self.kind == "point":
            d = {"type": "Point", "coordinates": at[0]}
        elif self.kind == "circle":
            d = {"type": "Circle", "coordinates": at[0], "radius": self.radius_km, "properties": {"radius_units": "km"}}
        elif self.kind == "line":
            d = {"type": "LineString", "coordinates": at}
        elif self.kind == "box":
            (s, w), (n, e) = self.coords
            d = {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}
        elif self.kind == "polygon":
            d = {"type": "Polygon", "coordinates": [at]}
        else:
            d = {"type": "GeometryCollection", "geometries": [json.loads(p.geojson()) for p in self.parts]}
        return json.dumps(d)


def point(lat: float, lon: float) -> Geoshape:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError(f"no such place: {lat}, {lon}")
    return Geoshape("point", ((float(lat), float(lon)),))


def circle(lat: float, lon: float, radius_km: float) -> Geoshape:
    if radius_km <= 0:
        raise ValueError("a circle needs a radius above 0")
    return Geoshape("circle", point(lat, lon).coords, float(radius_km))


def box(south: float, west: float, north: float, east: float) -> Geoshape:
    return Geoshape("box", point(south, west).coords + point(north, east).coords)


def line(*coords: tuple[float, float]) -> Geoshape:
    if len(coords) < 2:
        raise ValueError("a line needs two points")
    return Geoshape("line", tuple((float(a), float(b)) for a, b in coords))


def polygon(*coords: tuple[float, float]) -> Geoshape:
    """A ring; it is closed if it isn't."""
    ring = tuple((float(a), float(b)) for a, b in coords)
    ring = ring if ring[0] == ring[-1] else (*ring, ring[0])
    if len(ring) < 4:
        raise ValueError("a polygon needs three corners")
    return Geoshape("polygon", ring)


def multi(*parts: Geoshape) -> Geoshape:
    return Geoshape("multi", parts=parts)


def geoshape(value) -> Geoshape:
    """From WKT, GeoJSON (text or dict), 'lat, lon' text, or [lat, lon], [lat, lon, km] and [south, west, north, east] lists."""
    if isinstance(value, Geoshape):
        return value
    if isinstance(value, dict):
        return from_geojson(value)
    if isinstance(value, (list, tuple)):
        return {2: point, 3: circle, 4: box}[len(value)](*map(float, value))
    text = value.strip()
    if text.startswith("{"):
        return from_geojson(json.loads(text))
    if re.match(r"[A-Za-z]", text):
        return from_wkt(text)
    return geoshape([float(x) for x in re.split(r"[,;]", text)])


def from_geojson(d: dict) -> Geoshape:
    c, kind = d.get("coordinates"), d["type"]
    flip = lambda cs: tuple((float(lat), float(lon)) for lon, lat, *_ in cs)
    if kind == "Point":
        return point(c[1], c[0])
    if kind == "Circle":
        scale = {"km": 1.0, "kilometers": 1.0, "m": 0.001, "meters": 0.001, "mi": 1.609344}[d.get("properties", {}).get("radius_units", "km")]
        return circle(c[1], c[0], d["radius"] * scale)
    if kind == "LineString":
        return line(*flip(c))
    if kind == "Polygon":
        return polygon(*flip(c[0]))
    if kind in ("MultiPoint", "MultiLineString", "MultiPolygon"):
        return multi(*[from_geojson({"type": kind[5:], "coordinates": x}) for x in c])
    if kind == "GeometryCollection":
        return multi(*map(from_geojson, d["geometries"]))
    raise ValueError(f"no such shape: {kind}")


def from_wkt(text: str) -> Geoshape:
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*\((.*)\)\s*", text, re.S)
    if not m:
        raise ValueError(f"not WKT: {text}")
    kind, body = m[1].upper(), m[2]
    pairs = lambda s: [(float(y), float(x)) for x, y in (p.split()[:2] for p in s.replace("(", "").replace(")", "").split(","))]
    if kind == "POINT":
        return point(*pairs(body)[0])
    if kind == "BUFFER":
        inner, _, r = body.rpartition(",")
        return circle(*from_wkt(inner).coords[0], float(r))
    if kind == "ENVELOPE":
        w, e, n, s = map(float, body.split(","))
        return box(s, w, n, e)
    if kind == "LINESTRING":
        return line(*pairs(body))
    if kind == "POLYGON":
        return polygon(*pairs(body))
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(body + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    if kind == "GEOMETRYCOLLECTION":
        return multi(*map(from_wkt, parts))
    if kind in ("MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"):
        return multi(*[from_wkt(f"{kind[5:]} ({p.strip().strip('()')})") for p in parts])
    raise ValueError(f"no such shape: {kind}")


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine; each argument a Column or a number."""
    a, b, c, d = (F.radians(x if isinstance(x, Column) else F.lit(float(x))) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def point_in(lat: Column, lon: Column, s: Geoshape) -> Column:
    """Whether a point lies in (or on) the shape, as a native expression."""
    if s.kind == "point":
        return (lat == s.coords[0][0]) & (lon == s.coords[0][1])
    if s.kind == "circle":
        return distance_km(lat, lon, *s.coords[0]) <= s.radius_km
    if s.kind == "box":
        (south, west), (north, east) = s.coords
        across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
        return lat.between(south, north) & across
    edges = list(zip(s.coords[:-1], s.coords[1:], strict=True))
    on_edge = lambda p, q: (F.abs((lon - p[1]) * (q[0] - p[0]) - (lat - p[0]) * (q[1] - p[1])) < 1e-12) & lat.between(min(p[0], q[0]), max(p[0], q[0])) & lon.between(min(p[1], q[1]), max(p[1], q[1]))
    if s.kind == "line":
        return reduce(Column.__or__, [on_edge(p, q) for p, q in edges])
    if s.kind == "polygon":
        cross = [F.when(((lat < q[0]) != (lat < p[0])) & (lon < (q[1] - p[1]) * (lat - p[0]) / (q[0] - p[0]) + p[1]), 1).otherwise(0) for p, q in edges if p[0] != q[0]]
        return (reduce(Column.__add__, cross) % 2 == 1) | reduce(Column.__or__, [on_edge(p, q) for p, q in edges])
    return reduce(Column.__or__, [point_in(lat, lon, p) for p in s.parts])


# Shapes against shapes, on plain numbers -----------------------------------------------------------------------------


def _km(p, q) -> float:
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def _ring(s: Geoshape) -> list[tuple[float, float]]:
    """The outline; a circle as 72 points at its radius."""
    if s.kind == "box":
        (a, b), (c, d) = s.coords
        return [(a, b), (a, d), (c, d), (c, b), (a, b)]
    if s.kind == "circle":
        lat, lon = s.coords[0]
        r = math.degrees(s.radius_km / EARTH_KM)
        return [(lat + r * math.sin(t), lon + r * math.cos(t) / max(1e-9, math.cos(math.radians(lat)))) for t in (math.tau * i / 72 for i in range(73))]
    return list(s.coords)


def _covers(s: Geoshape, p: tuple[float, float]) -> bool:
    if s.kind == "multi":
        return any(_covers(x, p) for x in s.parts)
    if s.kind == "point":
        return s.coords[0] == p
    if s.kind == "circle":
        return _km(s.coords[0], p) <= s.radius_km
    ring, inside = _ring(s), False
    for a, b in zip(ring[:-1], ring[1:], strict=True):
        if abs((p[1] - a[1]) * (b[0] - a[0]) - (p[0] - a[0]) * (b[1] - a[1])) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
            return True
        if (p[0] < b[0]) != (p[0] < a[0]) and p[1] < (b[1] - a[1]) * (p[0] - a[0]) / (b[0] - a[0]) + a[1]:
            inside = not inside
    return inside and s.kind != "line"


def _cross(a, b, c, d) -> bool:
    side = lambda p, q, r: (q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def intersects(a: Geoshape, b: Geoshape) -> bool:
    if a.kind == "multi" or b.kind == "multi":
        return any(intersects(x, y) for x in (a.parts or (a,)) for y in (b.parts or (b,)))
    if a.kind == b.kind == "circle":
        return _km(a.coords[0], b.coords[0]) <= a.radius_km + b.radius_km
    if any(_covers(a, p) for p in _ring(b)) or any(_covers(b, p) for p in _ring(a)):
        return True
    ra, rb = _ring(a), _ring(b)
    return any(_cross(p, q, r, s) for p, q in zip(ra[:-1], ra[1:], strict=True) for r, s in zip(rb[:-1], rb[1:], strict=True))


def within(a: Geoshape, b: Geoshape) -> bool:
    """Whether all of a lies in b."""
    if a.kind == "multi":
        return all(within(x, b) for x in a.parts)
    if b.kind == "multi":
        return any(within(a, x) for x in b.parts)
    if a.kind == b.kind == "circle":
        return _km(a.coords[0], b.coords[0]) + a.radius_km <= b.radius_km
    if not all(_covers(b, p) for p in _ring(a)):
        return False
    ra, rb = _ring(a), _ring(b)
    return not any(_cross(p, q, r, s) for p, q in zip(ra[:-1], ra[1:], strict=True) for r, s in zip(rb[:-1], rb[1:], strict=True))


def _shape_test(relation, s: Geoshape):
    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        # Each different shape of a batch is parsed and tested once.
        known = {v: relation(geoshape(v), s) for v in values.dropna().unique()}
        return values.map(known).astype("boolean")

    return test


def _predicate(name: str, on_point, relation, shape, inverse=None) -> P:
    s = geoshape(shape)

    def test(c: Column, kind: str) -> Column:
        if kind.startswith("struct"):
            return c.isNotNull() & on_point(c["lat"], c["lon"], s)
        return _shape_test(relation, s)(c)

    return P(test, name, inverse)


def geo_within(shape) -> P:
    """The property lies in the shape."""
    return _predicate("geoWithin", point_in, within, shape)


def geo_intersect(shape) -> P:
    return _predicate("geoIntersect", point_in, intersects, shape, lambda: geo_disjoint(shape))


def geo_disjoint(shape) -> P:
    return _predicate("geoDisjoint", lambda a, b, s: ~point_in(a, b, s), lambda x, s: not intersects(x, s), shape, lambda: geo_intersect(shape))


def geo_contains(shape) -> P:
    """The shape lies in the property; a point contains only itself."""
    same = lambda a, b, s: (a == s.coords[0][0]) & (b == s.coords[0][1]) if s.kind == "point" else F.lit(False)
    return _predicate("geoContains", same, lambda x, s: within(s, x), shape)


def point_column(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
