"""Coordinates on a grid of 2^31 by 2^31 cells, and great-circle distance."""

from __future__ import annotations

import heapq
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of the mean radius, bits of the number of cells to an axis.
EARTH_RADIUS, BITS = 6_371_000.0, 31
CELLS = 1 << BITS


def snap_lat(lat: Column) -> Column:
    """The centre of the cell of a latitude."""
    cell = F.least(F.floor((F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0)) + 90.0) * (CELLS / 180.0)), F.lit(CELLS - 1))
    return F.when(lat.isNotNull(), (cell + 0.5) / (CELLS / 180.0) - 90.0)


def snap_lon(lon: Column) -> Column:
    """The centre of the cell of a longitude, wrapped to [-180, 180)."""
    wrapped = lon - F.floor((lon + 180.0) / 360.0) * 360.0
    cell = F.least(F.floor((wrapped + 180.0) * (CELLS / 360.0)), F.lit(CELLS - 1))
    return F.when(lon.isNotNull(), (cell + 0.5) / (CELLS / 360.0) - 180.0)


def zcode(lat: Column, lon: Column) -> Column:
    """The Z-order code of a coordinate: a sort key that keeps near points together in files. Null where empty."""
    y = F.least(F.floor((lat + 90.0) * (CELLS / 180.0)), F.lit(CELLS - 1))
    x = F.least(F.floor((lon - F.floor((lon + 180.0) / 360.0) * 360.0 + 180.0) * (CELLS / 360.0)), F.lit(CELLS - 1))

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.when(lat.isNotNull() & lon.isNotNull(), spread(y.cast("long")).bitwiseOR(F.shiftleft(spread(x.cast("long")), 1)))


def distance(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column) -> Column:
    """Metres between two points, infinite where either is empty."""
    lat0, lon0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat0, lon0))
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat, lat0) * half(lat, lat0) + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * half(lon, lon0) * half(lon, lon0)
    return F.when(h.isNull(), F.lit(float("inf"))).otherwise(2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def box(lat0: float, lon0: float, metres: float) -> tuple[float, float, list[tuple[float, float]]]:
    """The latitudes and the ranges of longitudes that a circle touches."""
    angle = math.degrees(metres / EARTH_RADIUS) + 1e-9
    south, north = lat0 - angle, lat0 + angle
    if south <= -90 or north >= 90:
        return max(south, -90.0), min(north, 90.0), [(-180.0, 180.0)]
    reach = math.degrees(math.asin(min(1.0, math.sin(math.radians(angle)) / math.cos(math.radians(lat0))))) + 1e-9
    west, east = lon0 - reach, lon0 + reach
    if east - west >= 360:
        return south, north, [(-180.0, 180.0)]
    if west < -180:
        return south, north, [(west + 360, 180.0), (-180.0, east)]
    if east > 180:
        return south, north, [(west, 180.0), (-180.0, east - 360)]
    return south, north, [(west, east)]


def _code(x: int, y: int) -> int:
    """The Z-order code of a cell."""
    return sum(((x >> i & 1) << 2 * i + 1) | ((y >> i & 1) << 2 * i) for i in range(BITS))


def cover(lat0: float, lon0: float, metres: float, most: int = 64) -> list[tuple[int, int]]:
    """At most `most` ranges of Z-order codes (first, last) that have all points of a circle.

    The squares of a quadtree that the circle's box touches: as long as there is room, the largest square that is not
    all inside the box is parted into four. Codes that follow each other make one range.
    """
    if metres < 0 or math.isnan(metres):
        return []
    south, north, parts = box(lat0, lon0, metres)
    down = lambda v, low, span: min(max(math.floor((v - low) * CELLS / span) - 1, 0), CELLS - 1)
    up = lambda v, low, span: min(max(math.floor((v - low) * CELLS / span) + 1, 0), CELLS - 1)
    bottom, top = down(south, -90.0, 180.0), up(north, -90.0, 180.0)
    sides = [(down(west, -180.0, 360.0), up(east, -180.0, 360.0)) for west, east in parts]
    # The cell after the last one at 180 degrees is the first one.
    if any(east == CELLS - 1 for _, east in sides):
        sides.append((0, 0))
    touches = lambda x, y, n: y <= top and y + n > bottom and any(x <= b and x + n > a for a, b in sides)
    inside = lambda x, y, n: y >= bottom and y + n - 1 <= top and any(x >= a and x + n - 1 <= b for a, b in sides)
    whole, open_ = [], [(-CELLS, 0, 0)]
    while open_:
        size, x, y = heapq.heappop(open_)
        if size == -1 or inside(x, y, -size):
            whole.append((x, y, -size))
            continue
        half = -size // 2
        quarters = [(-half, a, b) for a in (x, x + half) for b in (y, y + half) if touches(a, b, half)]
        if len(whole) + len(open_) + len(quarters) > most:
            whole += [(x, y, -size), *((a, b, -n) for n, a, b in open_)]
            break
        for q in quarters:
            heapq.heappush(open_, q)
    ranges: list[tuple[int, int]] = []
    for first, last in sorted((_code(x, y), _code(x, y) + n * n - 1) for x, y, n in whole):
        if ranges and ranges[-1][1] + 1 == first:
            ranges[-1] = (ranges[-1][0], last)
        else:
            ranges.append((first, last))
    return ranges


def is_covered(code: Column, lat0: float, lon0: float, metres: float, most: int = 64) -> Column:
    """Whether a stored column of `zcode` is in the cover of a circle. On files sorted by it the ranges leave out row groups."""
    ranges = cover(lat0, lon0, metres, most)
    return reduce(lambda a, b: a | b, [code.between(first, last) for first, last in ranges], F.lit(False))


def is_within(lat: Column, lon: Column, lat0: float, lon0: float, metres: float, code: Column | None = None) -> Column:
    """Whether a point is at most so far away. The box around the circle comes first: it reaches the scan as ranges, and
    so do those of `code`, if there is a stored column of Z-order codes; one computed here would be so for each range."""
    if metres < 0 or math.isnan(metres):
        return F.lit(False)
    if code is not None:
        return F.coalesce(is_covered(code, lat0, lon0, metres), F.lit(False)) & is_within(lat, lon, lat0, lon0, metres)
    south, north, parts = box(lat0, lon0, metres)
    east_west = F.lit(False)
    for west, east in parts:
        east_west = east_west | lon.between(west, east)
    return F.coalesce(lat.between(south, north) & east_west & (distance(lat, lon, lat0, lon0) <= metres), F.lit(False))
