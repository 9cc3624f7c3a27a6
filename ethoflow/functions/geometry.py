"""Plane geometry as Column expressions over polygon arrays, ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(points: Column) -> Column:
    return F.zip_with(points, F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd ray casting with half-open edges; false for null points and fewer than three vertices."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"] + F.lit(1e-12)) + e["ax"])
    odd = F.size(F.filter(_edges(points), crosses)) % 2 == 1
    return F.coalesce(odd & (F.size(points) >= 3), F.lit(False))


def border_distance(x: Column, y: Column, points: Column) -> Column:
    """Least distance to the polygon's border; an edge without length counts as its vertex."""

    def one(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        n = dx * dx + dy * dy
        t = F.when(n < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.when(n < 1e-12, F.lit(1.0)).otherwise(n))))
        return F.hypot(x - (e["ax"] + t * dx), y - (e["ay"] + t * dy))

    return F.array_min(F.transform(_edges(points), one))


def perimeter(points: Column) -> Column:
    return F.aggregate(_edges(points), F.lit(0.0), lambda a, e: a + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def wrap_degrees(angle: Column) -> Column:
    """An angle in (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - angle, F.lit(360.0))


def rectangle(x0: float, y0: float, x1: float, y1: float) -> list[dict]:
    return [{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def regular_polygon(cx: float, cy: float, r: float, n: int = 36) -> list[dict]:
    import math

    return [{"x": cx + r * math.cos(2 * math.pi * i / n), "y": cy + r * math.sin(2 * math.pi * i / n)} for i in range(n)]


def apparatus(kind: str, w: float, h: float) -> list[tuple[str, list[dict]]]:
    """Zone names and polygons of a standard apparatus that fills a w x h image with a margin of a tenth.

    kind: open_field, circular_field, plus_maze, y_maze, light_dark, three_chamber, water_maze, novel_object or fear_conditioning.
    """
    m = 0.1 * min(w, h)
    x0, y0, x1, y1 = m, m, w - m, h - m
    cx, cy = w / 2, h / 2
    arm = 0.1 * min(w, h) / 2
    if kind == "open_field":
        qx, qy = (x1 - x0) / 4, (y1 - y0) / 4
        return [("center", rectangle(x0 + qx, y0 + qy, x1 - qx, y1 - qy)), ("periphery", rectangle(x0, y0, x1, y1))]
    if kind == "plus_maze":
        return [("center", rectangle(cx - arm, cy - arm, cx + arm, cy + arm)), ("open arm n", rectangle(cx - arm, y0, cx + arm, cy - arm)), ("open arm s", rectangle(cx - arm, cy + arm, cx + arm, y1)), ("closed arm w", rectangle(x0, cy - arm, cx - arm, cy + arm)), ("closed arm e", rectangle(cx + arm, cy - arm, x1, cy + arm))]
    if kind == "light_dark":
        return [("light", rectangle(x0, y0, cx, y1)), ("dark", rectangle(cx, y0, x1, y1))]
    if kind == "three_chamber":
        third = (x1 - x0) / 3
        return [(n, rectangle(x0 + i * third, y0, x0 + (i + 1) * third, y1)) for i, n in enumerate(("left chamber", "center chamber", "right chamber"))]
    if kind == "water_maze":
        r = min(x1 - x0, y1 - y0) / 2
        pool = regular_polygon(cx, cy, r)
        quarters = [("nw", x0, y0, cx, cy), ("ne", cx, y0, x1, cy), ("sw", x0, cy, cx, y1), ("se", cx, cy, x1, y1)]
        return [(n, rectangle(*b)) for n, *b in quarters] + [("platform", regular_polygon(cx + r / 2, cy + r / 2, r / 8)), ("pool", pool)]
    if kind == "novel_object":
        return [("object_1", regular_polygon(x0 + (x1 - x0) / 4, cy, 2 * arm)), ("object_2", regular_polygon(x1 - (x1 - x0) / 4, cy, 2 * arm))]
    if kind == "circular_field":
        r = min(x1 - x0, y1 - y0) / 2
        return [("center", regular_polygon(cx, cy, 0.35 * r)), ("periphery", regular_polygon(cx, cy, r))]
    if kind == "y_maze":
        return [(f"arm {name}", turned_arm(cx, cy, 120 * i - 90, 2 * arm, min(x1 - x0, y1 - y0) / 2, 2 * arm)) for i, name in enumerate("abc")]
    if kind == "fear_conditioning":
        quarter = (x1 - x0) / 4
        return [(n, rectangle(x0 + i * quarter, y0, x0 + (i + 1) * quarter, y1)) for i, n in enumerate(("baseline", "cs tone 1", "iti 1", "cs tone 2"))]
    raise ValueError(f"unknown apparatus {kind!r}")


def turned_arm(cx: float, cy: float, degrees: float, near: float, far: float, half: float) -> list[dict]:
    """A rectangle from ``near`` to ``far`` of a centre in one direction, twice ``half`` wide."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [{"x": cx + a * c - b * s, "y": cy + a * s + b * c} for a, b in ((near, half), (far, half), (far, -half), (near, -half))]
