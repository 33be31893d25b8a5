"""Affine, map projection and radar geometry as column expressions."""

from __future__ import annotations

from math import atanh, cos, cosh, radians, sin, sinh, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 and UTM.
WGS84_A, WGS84_F, UTM_K0, UTM_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
KNOT_MS = 0.514444
MS_TO_KNOTS = 3600 / 1852


def ground(row: Column, col: Column, at=F.col) -> tuple[Column, Column]:
    """Ground coordinates of a pixel's centre under the affine columns a..f."""
    px, py = col + F.lit(0.5), row + F.lit(0.5)
    return at("a") * px + at("b") * py + at("c"), at("d") * px + at("e") * py + at("f")


def pixel(x: Column, y: Column, at=F.col) -> tuple[Column, Column]:
    """(px, py) of a ground point: the inverse of the affine, pixel corners at whole numbers."""
    det = at("a") * at("e") - at("b") * at("d")
    dx, dy = x - at("c"), y - at("f")
    return (at("e") * dx - at("b") * dy) / det, (at("a") * dy - at("d") * dx) / det


def inside(x: Column, y: Column, at=F.col) -> Column:
    """Strictly inside the image's footprint, whatever its rotation."""
    px, py = pixel(x, y, at)
    return (px > 0) & (px < at("width")) & (py > 0) & (py < at("height"))


def footprint(at=F.col) -> Column:
    """The four corners of the image on the ground, in ring order."""
    corners = ((F.lit(0), F.lit(0)), (at("width"), F.lit(0)), (at("width"), at("height")), (F.lit(0), at("height")))
    xy = [(at("a") * u + at("b") * v + at("c"), at("d") * u + at("e") * v + at("f")) for u, v in corners]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in xy])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def radar_shift(east_ms: Column, north_ms: Column, heading: Column, incidence: Column, per_mps: Column) -> tuple[Column, Column]:
    """(east, north) metres by which a right-looking radar draws a moving target off its place.

    The velocity along the line of sight, which lies right of the flight direction and down by the
    incidence, moves the echo along the flight direction. Unknown velocity gives NULL.
    """
    h, i = F.radians(heading), F.radians(incidence)
    along = per_mps * ((east_ms * F.cos(h) - north_ms * F.sin(h)) * F.sin(i))
    return along * F.sin(h), along * F.cos(h)


def radar_shift_of(east_ms: float, north_ms: float, heading: float, incidence: float, per_mps: float = 113.0) -> tuple[float, float]:
    h = radians(heading)
    along = per_mps * ((east_ms * cos(h) - north_ms * sin(h)) * sin(radians(incidence)))
    return along * sin(h), along * cos(h)


def course_deg(east_ms: Column, north_ms: Column) -> Column:
    """Degrees clockwise from grid north; NULL without velocity or at rest."""
    speed = F.sqrt(east_ms * east_ms + north_ms * north_ms)
    return F.when(speed > 0, F.pmod(F.degrees(F.atan2(east_ms, north_ms)), F.lit(360.0)))


def speed_kn(east_ms: Column, north_ms: Column) -> Column:
    return F.sqrt(east_ms * east_ms + north_ms * north_ms) * F.lit(MS_TO_KNOTS)


def pixel_box(x0: Column, y0: Column, x1: Column, y1: Column, at=F.col) -> Column:
    """A ground rectangle as an ordered pixel box, rounded half-even to hundredths."""
    (ax, ay), (bx, by) = pixel(x0, y0, at), pixel(x1, y1, at)
    two = lambda c: F.bround(c, 2)
    return F.struct(
        two(F.least(ax, bx)).alias("px"), two(F.least(ay, by)).alias("py"), two(F.abs(bx - ax)).alias("pw"), two(F.abs(by - ay)).alias("ph")
    )


class TransverseMercator:
    """UTM on WGS 84 by the Krueger series of sixth order in the third flattening; sub-millimetre in the zone."""

    def __init__(self, zone: int, south: bool = False):
        if not 1 <= zone <= 60:
            raise ValueError("a UTM zone is 1 to 60")
        self.zone, self.lon0, self.north0 = zone, radians(6 * zone - 183), 10_000_000.0 if south else 0.0
        n = WGS84_F / (2 - WGS84_F)
        self.e = sqrt(WGS84_F * (2 - WGS84_F))
        self.radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
        # The coefficients of the forward and the inverse series, by power of n.
        forward = [
            [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
            [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
            [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
            [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
            [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
            [0, 0, 0, 0, 0, 212378941 / 319334400],
        ]
        inverse = [
            [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
            [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
            [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
            [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
            [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680],
            [0, 0, 0, 0, 0, 20648693 / 638668800],
        ]
        self.alpha = [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in forward]
        self.beta = [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in inverse]

    @classmethod
    def of(cls, crs: str) -> "TransverseMercator":
        """From ``EPSG:326zz``, ``EPSG:327zz`` or ``EPSG:258zz``."""
        code = int(crs.upper().removeprefix("EPSG:"))
        family, zone = divmod(code, 100)
        if family not in (326, 327, 258):
            raise ValueError(f"{crs} is not a UTM zone that this engine projects")
        return cls(zone, south=family == 327)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) metres of degrees."""
        p, dl = F.radians(lat), F.radians(lon) - F.lit(self.lon0)
        s = F.sin(p)
        t = F.sinh(F.atanh(s) - F.lit(self.e) * F.atanh(F.lit(self.e) * s))
        xi, eta = F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) * F.cos(dl)))
        north, east = xi, eta
        for j, a in enumerate(self.alpha, 1):
            north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        k = F.lit(UTM_K0 * self.radius)
        return F.lit(UTM_EAST) + k * east, F.lit(self.north0) + k * north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat) degrees of metres, to 1e-11 of a degree: the latitude takes five fixed-point steps."""
        k = F.lit(UTM_K0 * self.radius)
        xi, eta = (y - F.lit(self.north0)) / k, (x - F.lit(UTM_EAST)) / k
        a, b = xi, eta
        for j, c in enumerate(self.beta, 1):
            a = a - F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            b = b - F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        conformal = F.asin(F.sin(a) / F.cosh(b))
        isometric = F.atanh(F.sin(conformal))
        s = F.sin(conformal)
        for _ in range(5):
            s = F.tanh(isometric + F.lit(self.e) * F.atanh(F.lit(self.e) * s))
        return F.degrees(F.lit(self.lon0) + F.atan2(F.sinh(b), F.cos(a))), F.degrees(F.asin(s))

    def forward_of(self, lon: float, lat: float) -> tuple[float, float]:
        p, dl = radians(lat), radians(lon) - self.lon0
        t = sinh(atanh(sin(p)) - self.e * atanh(self.e * sin(p)))
        xi, eta = np.arctan2(t, cos(dl)), np.arcsinh(sin(dl) / np.hypot(t, cos(dl)))
        north = xi + sum(a * sin(2 * j * xi) * cosh(2 * j * eta) for j, a in enumerate(self.alpha, 1))
        east = eta + sum(a * cos(2 * j * xi) * sinh(2 * j * eta) for j, a in enumerate(self.alpha, 1))
        k = UTM_K0 * self.radius
        return UTM_EAST + k * east, self.north0 + k * north


