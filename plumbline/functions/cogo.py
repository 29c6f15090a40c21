"""Coordinate geometry as column functions; azimuths are degrees clockwise from north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse(n1: Column, e1: Column, n2: Column, e2: Column) -> tuple[Column, Column]:
    """Distance and azimuth from point 1 to point 2; the azimuth of coincident points is 0."""
    dn, de = n2 - n1, e2 - e1
    azimuth = F.pmod(F.degrees(F.atan2(de, dn)), F.lit(360.0))
    return F.sqrt(dn * dn + de * de), F.when((dn == 0) & (de == 0), 0.0).otherwise(azimuth)


def forward(n: Column, e: Column, azimuth: Column, distance: Column) -> tuple[Column, Column]:
    """The point at a distance along an azimuth."""
    return n + distance * F.cos(F.radians(azimuth)), e + distance * F.sin(F.radians(azimuth))


def line_intersection(n1: Column, e1: Column, az1: Column, n2: Column, e2: Column, az2: Column) -> tuple[Column, Column]:
    """Where two lines of known azimuth meet; null when they are parallel."""
    c1, s1, c2, s2 = F.cos(F.radians(az1)), F.sin(F.radians(az1)), F.cos(F.radians(az2)), F.sin(F.radians(az2))
    det = s1 * c2 - c1 * s2
    t = F.when(F.abs(det) >= 1e-12, ((e2 - e1) * c2 - (n2 - n1) * s2) / F.when(F.abs(det) >= 1e-12, det))
    return n1 + t * c1, e1 + t * s1


def curve_from_radius_delta(radius: Column, delta_deg: Column) -> dict[str, Column]:
    """Tangent, arc, chord, external, middle ordinate and degree of curve (arc definition)."""
    half = F.radians(delta_deg) / 2
    return {
        "tangent": radius * F.tan(half),
        "arc_length": radius * F.radians(delta_deg),
        "long_chord": 2 * radius * F.sin(half),
        "external": radius * (1 / F.cos(half) - 1),
        "middle_ordinate": radius * (1 - F.cos(half)),
        "degree_of_curve": 18000.0 / (math.pi * radius),
    }


def delta_from_tangent_arc(tangent: Column, arc: Column, rounds: int = 12) -> Column:
    """Central angle in degrees from tangent and arc length: Newton on ``tan(x) / x = 2T / L`` with x the half angle."""
    ratio = 2 * tangent / arc
    step = lambda x, _: x - (F.tan(x) - ratio * x) / (1 / (F.cos(x) * F.cos(x)) - ratio)
    begin = F.least(F.sqrt(3 * (ratio - 1)), F.lit(1.5))
    half = F.aggregate(F.array_repeat(F.lit(0), rounds), begin, step)
    return F.when(ratio > 1, F.degrees(2 * half))


def circle_through(n1, e1, n2, e2, n3, e3) -> tuple[Column, Column, Column]:
    """Centre and radius of the circle through three points; null when they are in line."""
    d = 2 * (e1 * (n2 - n3) + e2 * (n3 - n1) + e3 * (n1 - n2))
    d = F.when(F.abs(d) >= 1e-12, d)
    s1, s2, s3 = e1 * e1 + n1 * n1, e2 * e2 + n2 * n2, e3 * e3 + n3 * n3
    e = (s1 * (n2 - n3) + s2 * (n3 - n1) + s3 * (n1 - n2)) / d
    n = (s1 * (e3 - e2) + s2 * (e1 - e3) + s3 * (e2 - e1)) / d
    return n, e, F.sqrt((n1 - n) * (n1 - n) + (e1 - e) * (e1 - e))


def vertical_curve(bvc_elevation: Column, grade_in: Column, grade_out: Column, length: Column, x: Column) -> Column:
    """Elevation at ``x`` from the start of a parabola; grades in percent."""
    g1, g2 = grade_in / 100, grade_out / 100
    return bvc_elevation + g1 * x + (g2 - g1) * x * x / (2 * length)


def turning_point(grade_in: Column, grade_out: Column, length: Column) -> Column:
    """Distance of a vertical curve's high or low point; null when it has none inside."""
    change = F.when(grade_in != grade_out, grade_in - grade_out)
    x = grade_in * length / change
    return F.when((x > 0) & (x < length), x)


def local_site(e: Column, n: Column, rotation_deg: float, factor: float, e0: float, n0: float) -> tuple[Column, Column]:
    """Grid to local site: clockwise rotation about an origin, then scale."""
    c, s = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))
    return ((e - e0) * c + (n - n0) * s) * factor, (-(e - e0) * s + (n - n0) * c) * factor


def similarity(x: Column, y: Column, scale: float, rotation_deg: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Counter-clockwise rotation and scale about the origin, then a shift."""
    a, b = scale * math.cos(math.radians(rotation_deg)), scale * math.sin(math.radians(rotation_deg))
    return a * x - b * y + dx, b * x + a * y + dy


def similarity_inverse(x: Column, y: Column, scale: float, rotation_deg: float, dx: float, dy: float) -> tuple[Column, Column]:
    a, b = scale * math.cos(math.radians(rotation_deg)), scale * math.sin(math.radians(rotation_deg))
    q = a * a + b * b
    return (a * (x - dx) + b * (y - dy)) / q, (-b * (x - dx) + a * (y - dy)) / q


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator of degrees; the one projection that needs no external library."""
    r = 6378137.0
    return r * F.radians(lon), r * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def inside_area(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether degrees lie in an area of use, borders included; null for null."""
    return lon.between(west, east) & lat.between(south, north)
