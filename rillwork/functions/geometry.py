"""Polylines as arrays of (x, y) structs: measures, linear referencing, clipping and predicates as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def segments(line: Column) -> Column:
    """Array of (a, b) structs of consecutive points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _len(s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    return F.sqrt(dx * dx + dy * dy)


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + _len(s))


def bounds(line: Column) -> dict[str, Column]:
    return {
        "xmin": F.array_min(F.transform(line, lambda p: p["x"])), "ymin": F.array_min(F.transform(line, lambda p: p["y"])),
        "xmax": F.array_max(F.transform(line, lambda p: p["x"])), "ymax": F.array_max(F.transform(line, lambda p: p["y"])),
    }


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_contains(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def along(line: Column, at: Column) -> Column:
    """The point at a distance along the line, clamped to its ends."""
    zero = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("struct<x:double,y:double>").alias("p"))

    def step(acc: Column, s: Column) -> Column:
        own = _len(s)
        t = F.when(own > 0, (F.greatest(at, F.lit(0.0)) - acc["done"]) / own).otherwise(F.lit(0.0))
        here = F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))
        hit = acc["p"].isNull() & (acc["done"] + own >= F.greatest(at, F.lit(0.0)))
        return F.struct((acc["done"] + own).alias("done"), F.when(hit, here).otherwise(acc["p"]).alias("p"))

    return F.coalesce(F.aggregate(segments(line), zero, step, lambda acc: acc["p"]), F.element_at(line, -1))


def midpoint(line: Column) -> Column:
    return along(line, length(line) / 2)


def sample(line: Column, step: float) -> Column:
    """Points every `step` metres from the start, the start included."""
    return F.transform(F.sequence(F.lit(0), F.floor(length(line) / step).cast("int")), lambda k: along(line, k * F.lit(float(step))))


def point_distance(line: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest place of the line."""
    def one(s: Column) -> Column:
        vx, vy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        d = vx * vx + vy * vy
        t = F.when(d > 0, F.least(F.greatest(((x - s["a"]["x"]) * vx + (y - s["a"]["y"]) * vy) / d, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        ex, ey = s["a"]["x"] + t * vx - x, s["a"]["y"] + t * vy - y
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(F.transform(segments(line), one))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring (closed or not): positive if counter-clockwise."""
    closed = F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
    return F.aggregate(segments(closed), F.lit(0.0), lambda t, s: t + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def ring_centroid(ring: Column) -> Column:
    closed = F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    a = ring_area(ring)
    sx = F.aggregate(segments(closed), F.lit(0.0), lambda t, s: t + (s["a"]["x"] + s["b"]["x"]) * cross(s))
    sy = F.aggregate(segments(closed), F.lit(0.0), lambda t, s: t + (s["a"]["y"] + s["b"]["y"]) * cross(s))
    return F.struct((sx / (6 * a)).alias("x"), (sy / (6 * a)).alias("y"))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test by counting the edges that a ray to the right crosses; half-open, so shared edges count once."""
    closed = F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))

    def crosses(s: Column) -> Column:
        over = (s["a"]["y"] > y) != (s["b"]["y"] > y)
        at = s["a"]["x"] + (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"])
        return F.when(over & (x < at), 1).otherwise(0)

    return F.aggregate(segments(closed), F.lit(0), lambda t, s: t + crosses(s)) % 2 == 1


def segment_crossing(ax, ay, bx, by, cx, cy, dx, dy) -> dict[str, Column]:
    """Crossing point of segments ab and cd: hit, x, y (null if they do not cross or are parallel)."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.when(den != 0, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den)
    u = F.when(den != 0, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den)
    hit = F.coalesce((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.lit(False))
    return {"hit": hit, "x": F.when(hit, ax + t * (bx - ax)), "y": F.when(hit, ay + t * (by - ay))}


def clip_segment(ax, ay, bx, by, xmin: float, ymin: float, xmax: float, ymax: float) -> dict[str, Column]:
    """Liang-Barsky: parameters t0 and t1 of the part of ab inside the box; null if none."""
    dx, dy = bx - ax, by - ay
    low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for d, near, far in ((dx, F.lit(float(xmin)) - ax, F.lit(float(xmax)) - ax), (dy, F.lit(float(ymin)) - ay, F.lit(float(ymax)) - ay)):
        enter = F.when(d > 0, near / d).when(d < 0, far / d)
        leave = F.when(d > 0, far / d).when(d < 0, near / d)
        ok = ok & F.when(d == 0, (near <= 0) & (far >= 0)).otherwise(F.lit(True))
        low, high = F.greatest(low, F.coalesce(enter, F.lit(0.0))), F.least(high, F.coalesce(leave, F.lit(1.0)))
    inside = ok & (low <= high)
    return {"t0": F.when(inside, low), "t1": F.when(inside, high)}


def simplify(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas-Peucker keeps, without recursion."""
    n = len(xy)
    keep = np.zeros(n, bool)
    if not n:
        return np.flatnonzero(keep)
    keep[[0, n - 1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, v = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
        size = v @ v
        t = np.clip(p @ v / size, 0, 1) if size > 0 else np.zeros(len(p))
        d = np.sqrt(((p - t[:, None] * v) ** 2).sum(1))
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def substring(xy: np.ndarray, start: float, end: float) -> np.ndarray:
    """The part of a line between two distances along it."""
    steps = np.hypot(*np.diff(xy, axis=0).T)
    cum = np.concatenate([[0.0], np.cumsum(steps)])
    start, end = np.clip([start, end], 0, cum[-1])
    at = lambda d: np.array([np.interp(d, cum, xy[:, 0]), np.interp(d, cum, xy[:, 1])])
    inner = xy[(cum > start) & (cum < end)]
    return np.vstack([at(start), inner, at(end)])


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Of two point sets: the largest distance from a point of either to the other, in blocks."""
    def one(p, q):
        return max(np.sqrt(((p[i : i + 512, None] - q[None]) ** 2).sum(2)).min(1).max() for i in range(0, len(p), 512))

    return float(max(one(a, b), one(b, a)))
