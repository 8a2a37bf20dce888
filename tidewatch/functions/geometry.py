"""Measures of rings as array expressions. A ring is a closed array of points (x, y): the first point comes again as the last.

Nothing here leaves the JVM. On a sphere x is the longitude and y the latitude, in degrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mean radius of the earth in kilometres.
RADIUS_KM = 6371.0088


def along(ring: Column, value: Callable[[Column, Column], Column]) -> Column:
    """The sum of a value of each edge, from its two points."""
    n = F.size(ring) - 1
    return F.aggregate(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), value), F.lit(0.0), lambda s, v: s + v)


def closed(ring: Column) -> Column:
    return (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def signed_area(ring: Column) -> Column:
    """Positive for a ring that runs against the clock."""
    return F.when(F.size(ring) > 1, along(ring, lambda a, b: (a.x * b.y - b.x * a.y).cast("double")) / 2).otherwise(F.lit(0.0))


def length(ring: Column) -> Column:
    return F.when(F.size(ring) > 1, along(ring, lambda a, b: F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))).otherwise(F.lit(0.0))


def reversed_to(ring: Column, counter: bool) -> Column:
    """The ring as it runs against the clock, or with it."""
    return F.when((signed_area(ring) > 0) == F.lit(counter), ring).otherwise(F.reverse(ring))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside the ring: a ray to the right crosses it an odd number of times. Of points on the ring
    itself, those on left and lower edges count as inside."""

    def crosses(a: Column, b: Column) -> Column:
        side = (b.x - a.x) * (y - a.y) - (x - a.x) * (b.y - a.y)
        up = (a.y <= y) & (b.y > y) & (side >= 0)
        down = (a.y > y) & (b.y <= y) & (side <= 0)
        return F.when(up | down, 1.0).otherwise(0.0)

    return F.when(F.size(ring) > 1, along(ring, crosses) % 2 == 1).otherwise(F.lit(False))


def geodesic_area_km2(ring: Column) -> Column:
    """The area that a ring of longitudes and latitudes encloses on the sphere, edges as lines of the plate carrée chart."""
    strip = lambda a, b: (F.radians(b.x) - F.radians(a.x)) * (2 + F.sin(F.radians(a.y)) + F.sin(F.radians(b.y)))
    return F.abs(along(ring, strip)) * (RADIUS_KM * RADIUS_KM / 2)


def geodesic_length_km(ring: Column) -> Column:
    """The sum of great-circle distances between the points."""

    def arc(a: Column, b: Column) -> Column:
        p, q = F.radians(a.y), F.radians(b.y)
        u, v = F.sin((q - p) / 2), F.sin((F.radians(b.x) - F.radians(a.x)) / 2)
        return F.asin(F.sqrt(u * u + F.cos(p) * F.cos(q) * v * v)) * (2 * RADIUS_KM)

    return along(ring, arc)


def simplified(ring: Column, least_area: float, passes: int = 1) -> Column:
    """The ring without points whose triangle with both neighbours is smaller than least_area and not larger than those of the
    neighbours. A point's fate hangs on the two points on either side, whichever way the ring runs, so a line that two units
    share stays shared. First and last points stay, and a ring of four points or fewer is kept as it is."""
    for _ in range(passes):
        ring = _without_small(ring, least_area)
    return ring


def _without_small(ring: Column, least_area: float) -> Column:
    n = F.size(ring)

    def at(i: Column) -> Column:
        return F.get(ring, F.when(i < 0, n - 2).when(i >= n, F.lit(1)).otherwise(i))

    def triangle(i: Column) -> Column:
        a, b, c = at(i - 1), at(i), at(i + 1)
        return F.abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2

    def stays(p: Column, i: Column) -> Column:
        return (i == 0) | (i == n - 1) | ~((triangle(i) < least_area) & (triangle(i) <= triangle(i - 1)) & (triangle(i) <= triangle(i + 1)))

    return F.when(n <= 4, ring).otherwise(F.filter(ring, stays))
