"""Scalar geometry as column expressions; all stay in the JVM and fold into code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def length(*d: Column) -> Column:
    return F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))


def distance(a: Point, b: Point) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def middle(a: Column, b: Column, c: Column) -> Column:
    return F.get(F.array_sort(F.array(a, b, c)), F.lit(1))


def cross(o: Point, a: Point, b: Point) -> Column:
    """Positive if o, a, b turn against the clock (y up)."""
    return (a[0] - o[0]) * (b[1] - o[1]) - (b[0] - o[0]) * (a[1] - o[1])


def direction(a: Point, b: Point) -> Column:
    return F.atan2(b[1] - a[1], b[0] - a[0])


def visual_angle(a: Point, b: Point, o: Point) -> Column:
    """Angle a-o-b by the law of cosines, clamped; 0 if a point falls on o."""
    p, q, r = distance(a, o), distance(b, o), distance(a, b)
    ratio = F.try_divide(p * p + q * q - r * r, 2 * p * q)
    return F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))), F.lit(0.0))


def signed_visual_angle(a: Point, b: Point, o: Point) -> Column:
    return F.when(cross(o, a, b) < 0, -visual_angle(a, b, o)).otherwise(visual_angle(a, b, o))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Heron's formula from three sides; 0 if they form no triangle."""
    s = (a + b + c) / 2
    p = s * (s - a) * (s - b) * (s - c)
    return F.when(p > 0, F.sqrt(p)).otherwise(0.0)


def project_to_line(p: Point, a: Point, b: Point) -> tuple[Column, Column, Column]:
    """(x, y, t): the foot on the line through a and b, and its place (0 at a, 1 at b); of equal ends a itself."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = F.coalesce(F.try_divide((p[0] - a[0]) * dx + (p[1] - a[1]) * dy, dx * dx + dy * dy), F.lit(0.0))
    return a[0] + t * dx, a[1] + t * dy, t


def distance_to_line(p: Point, a: Point, b: Point) -> Column:
    x, y, _ = project_to_line(p, a, b)
    return distance(p, (x, y))


def distance_to_segment(p: Point, a: Point, b: Point) -> Column:
    _, _, t = project_to_line(p, a, b)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def crosses_ray(p: Point, a: Point, b: Point) -> Column:
    """Does the edge a-b cross the ray from p to the right? An odd number of crossings means inside."""
    over = (a[1] > p[1]) != (b[1] > p[1])
    at = a[0] + F.try_divide((p[1] - a[1]) * (b[0] - a[0]), b[1] - a[1])
    return over & F.coalesce(p[0] < at, F.lit(False))


def unit(v: Sequence[Column]) -> list[Column]:
    """v / |v|; the zero vector stays zero."""
    n = length(*v)
    return [F.coalesce(F.try_divide(x, n), F.lit(0.0)) for x in v]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross3(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def bisector(a: Point, o: Point, b: Point) -> list[Column]:
    """Unit vector that halves the angle a-o-b."""
    u, v = unit([a[0] - o[0], a[1] - o[1]]), unit([b[0] - o[0], b[1] - o[1]])
    return unit([u[0] + v[0], u[1] + v[1]])


def segment_intersection(p: Point, p2: Point, q: Point, q2: Point) -> tuple[Column, Column]:
    """(s, t): where the segments' lines cross, as places on each; null if parallel."""
    rx, ry, sx, sy = p2[0] - p[0], p2[1] - p[1], q2[0] - q[0], q2[1] - q[1]
    det = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    return ((q[0] - p[0]) * sy - (q[1] - p[1]) * sx) / det, ((q[0] - p[0]) * ry - (q[1] - p[1]) * rx) / det


def parallel(u: Point, v: Point, eps: float = 1e-6) -> Column:
    return F.abs(u[0] * v[1] - u[1] * v[0]) <= eps * length(*u) * length(*v)


def collinear(a: Point, b: Point, c: Point, eps: float = 1e-6) -> Column:
    return F.abs(cross(a, b, c)) <= eps


def approaching(p: Point, vp: Point, q: Point, vq: Point) -> Column:
    """Does the distance of two moving points shrink?"""
    return (p[0] - q[0]) * (vp[0] - vq[0]) + (p[1] - q[1]) * (vp[1] - vq[1]) < 0


def plane_line(normal: Sequence[Column], d: Column, o: Sequence[Column], v: Sequence[Column]) -> Column:
    """Place t on o + t v where normal . x = d; null if parallel."""
    return F.try_divide(d - dot(normal, o), dot(normal, v))


def linear_index(dims: Sequence[int], *sub: Column) -> Column:
    """Subscripts to a linear index, first axis fastest."""
    total, stride = F.lit(0).cast("bigint"), 1
    for n, s in zip(dims, sub, strict=True):
        total, stride = total + s.cast("bigint") * stride, stride * n
    return total


def subscripts(dims: Sequence[int], index: Column) -> list[Column]:
    out, stride = [], 1
    for n in dims:
        out.append((F.floor(index / stride) % n).cast("int"))
        stride *= n
    return out


def vector_distance(a: Column, b: Column) -> Column:
    """L2 distance of two arrays; null if their lengths differ."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(s))


def logistic_length(d: Column, scale: float) -> Column:
    return 1 / (1 + F.exp((d - scale) / scale))


def angle_term(theta: Column) -> Column:
    return (1 - F.cos(theta)) / 2


def gaussian_compatibility(dv2: Column, sigma: float) -> Column:
    """exp(-dv^2 / 2 sigma^2), 0 beyond dv^2 = 2 sigma^2."""
    return F.when(dv2 > 2 * sigma * sigma, 0.0).otherwise(F.exp(-dv2 / (2 * sigma * sigma)))


def quadratic_at(x: Column, a: Column, b: Column, t: Column) -> Column:
    return x + a * t * t + b * t


def branch_similarity(dpos2: Column, dvel2: Column, alpha: float = 1.0) -> Column:
    return 1 / (1 + F.sqrt(dpos2 + alpha * dvel2))


def circular_symbol_distance(a: Column, b: Column, n: int = 8) -> Column:
    return F.least(F.abs(a - b), n - F.abs(a - b))


def new_dimension(old: Column, ratio: float) -> Column:
    """Size after a change of spacing by ``ratio``; odd stays odd and even even, so that the centre stays."""
    n = F.floor(old * ratio).cast("int")
    return F.when(n % 2 == old % 2, n).otherwise(n + 1)
