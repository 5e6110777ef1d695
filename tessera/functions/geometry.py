"""Polygons as arrays of vertices: reading, boxes, extremes, moments, angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wkt_rings(wkt: Column) -> Column:
    """All rings of a ``POLYGON``, the exterior first, as arrays of (x, y)."""
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(bodies, _vertices)


def wkt_ring(wkt: Column) -> Column:
    """The exterior ring."""
    return _vertices(F.regexp_extract(wkt, r"\(\(([^()]+)\)", 1))


def _vertices(body: Column) -> Column:
    def vertex(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.transform(F.split(body, ","), vertex)


def _axis(ring: Column, name: str) -> Column:
    return F.transform(ring, lambda v: v[name])


def bbox(ring: Column, width: int = 1024, height: int = 1024) -> Column:
    """Whole-pixel box of a ring, clamped to the raster: struct (x1, y1, x2, y2)."""
    def clamp(value: Column, most: int) -> Column:
        return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(most)).cast("int")

    xs, ys = _axis(ring, "x"), _axis(ring, "y")
    return F.struct(
        clamp(F.array_min(xs), width).alias("x1"), clamp(F.array_min(ys), height).alias("y1"),
        clamp(F.array_max(xs), width).alias("x2"), clamp(F.array_max(ys), height).alias("y2"),
    )


def farthest_points(ring: Column) -> Column:
    """The pair of vertices farthest apart, struct (d2, i, j); of equal ones the first in order of (i, j)."""
    pairs = F.flatten(F.transform(ring, lambda a, i: F.transform(ring, lambda b, j: F.struct(
        ((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])).alias("d2"), (-i).alias("i"), (-j).alias("j")))))
    best = F.array_max(pairs)
    return F.struct(best["d2"].alias("d2"), (-best["i"]).alias("i"), (-best["j"]).alias("j"))


def area_centroid(ring: Column) -> Column:
    """Centroid of the area (shoelace) of a closed ring: struct (x, y, area2), area2 twice the signed area."""
    edges = F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda a, i: F.struct(
        a["x"].alias("x"), a["y"].alias("y"), F.get(ring, i + 1)["x"].alias("u"), F.get(ring, i + 1)["y"].alias("v")))

    def total(weight) -> Column:
        return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + (e["x"] * e["v"] - e["u"] * e["y"]) * weight(e))

    area2 = total(lambda e: F.lit(1.0))
    return F.struct(
        F.try_divide(total(lambda e: e["x"] + e["u"]), 3 * area2).alias("x"),
        F.try_divide(total(lambda e: e["y"] + e["v"]), 3 * area2).alias("y"), area2.alias("area2"),
    )


def vertex_moments(ring: Column, x: Column, y: Column) -> Column:
    """Second moments of the vertices about (x, y): struct (xx, yy, xy)."""
    def total(term) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, v: acc + term(v["x"] - x, v["y"] - y))

    return F.struct(total(lambda a, b: a * a).alias("xx"), total(lambda a, b: b * b).alias("yy"), total(lambda a, b: a * b).alias("xy"))


def orientation_vector(ring: Column, box: Column) -> Column:
    """From the centre of the box to the farther end of the longest diagonal of the ring (the first, where equal)."""
    cx, cy = (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2
    ends = farthest_points(ring)
    a, b = F.get(ring, ends["i"]), F.get(ring, ends["j"])

    def d2(p: Column) -> Column:
        return (p["x"] - cx) * (p["x"] - cx) + (p["y"] - cy) * (p["y"] - cy)

    far = F.when(d2(b) > d2(a), b).otherwise(a)
    return F.struct((far["x"] - cx).alias("x"), (far["y"] - cy).alias("y"))


def rotation_angle(a: Column, b: Column) -> Column:
    """Degrees from vector ``a`` to ``b``; negative where the cross product isn't positive. Null for a zero vector."""
    norm = F.sqrt(a["x"] * a["x"] + a["y"] * a["y"]) * F.sqrt(b["x"] * b["x"] + b["y"] * b["y"])
    dot = F.try_divide(a["x"] * b["x"] + a["y"] * b["y"], norm)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    return F.when(a["x"] * b["y"] - a["y"] * b["x"] > 0, angle).otherwise(-angle)


def scale_to_box(donor: Column, host: Column) -> Column:
    """Size of a donor scaled to the host's box, and the factors: struct (width, height, fx, fy). Sizes are one pixel at least."""
    def side(box: Column, low: str, high: str) -> Column:
        return box[high] - box[low]

    w, h = side(host, "x1", "x2"), side(host, "y1", "y2")
    return F.struct(
        F.greatest(w, F.lit(1)).alias("width"), F.greatest(h, F.lit(1)).alias("height"),
        F.try_divide(w.cast("double"), side(donor, "x1", "x2").cast("double")).alias("fx"), F.try_divide(h.cast("double"), side(donor, "y1", "y2").cast("double")).alias("fy"))
