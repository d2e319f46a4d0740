"""Vector and geometry functions as Column expressions.

Missing values are NULL, never NaN: ``nan_to_null`` is applied when data comes in. A NULL coordinate makes the result
NULL. Divisions by zero give NULL, so zero vectors have no direction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def array_nan_to_null(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(~F.isnan(x), x))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def distance(a: Column, b: Column) -> Column:
    """L2 distance of two arrays."""
    return norm(sub(a, b))


def distance_of(pairs: list[tuple[Column, Column]]) -> Column:
    """L2 distance of two points given as scalar columns: flat code, no lambdas."""
    return F.sqrt(reduce(lambda p, q: p + q, ((a - b) * (a - b) for a, b in pairs)))


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def scale(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: x * s)


def unit(v: Column) -> Column:
    """The vector at length 1; NULL coordinates for a zero vector."""
    n = norm(v)
    return F.transform(v, lambda x: F.try_divide(x, n))


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def transpose3(m: Column) -> Column:
    at = lambda i, j: F.element_at(F.element_at(m, i), j)
    return F.array(*(F.array(*(at(i, j) for i in (1, 2, 3))) for j in (1, 2, 3)))


def inverse3(m: Column, least: float = 1e-12) -> Column:
    """Inverse of a 3x3 matrix by cofactors; NULL where the determinant is under ``least`` of the rows' lengths, or unknown."""
    at = lambda i, j: F.element_at(F.element_at(m, i + 1), j + 1)
    minor = lambda i, j: at((i + 1) % 3, (j + 1) % 3) * at((i + 2) % 3, (j + 2) % 3) - at((i + 1) % 3, (j + 2) % 3) * at((i + 2) % 3, (j + 1) % 3)
    det = at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2)
    size = reduce(lambda p, q: p * q, (norm(F.element_at(m, i)) for i in (1, 2, 3)))
    return F.when(F.abs(det) > size * least, F.array(*(F.array(*(minor(j, i) / det for j in range(3))) for i in range(3))))


def is_rotation(m: Column, tolerance: float = 0.01) -> Column:
    """Whether the rows of a 3x3 matrix are orthonormal."""
    row = lambda i: F.element_at(m, i)
    off = [F.abs(dot(row(i), row(j)) - F.lit(float(i == j))) for i in (1, 2, 3) for j in range(i, 4)]
    return F.greatest(*off) <= tolerance


def point_line_distance(point: Column, line_point: Column, direction: Column) -> Column:
    """Distance of a point from the infinite line through ``line_point``; NULL for a zero direction."""
    gap = sub(point, line_point)
    along = F.try_divide(dot(direction, gap), dot(direction, direction))
    return norm(sub(gap, scale(direction, along)))


def clip(x: Column, low: float, high: float) -> Column:
    """Between the bounds; NULL stays NULL (bare greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle between AB and BC in degrees: 0 for a straight line, NULL where points coincide."""
    ab, bc = sub(b, a), sub(c, b)
    return F.degrees(F.acos(clip(F.try_divide(dot(ab, bc), norm(ab) * norm(bc)), -1.0, 1.0)))


def pitch_yaw(v: Column) -> tuple[Column, Column]:
    """Pitch and yaw of a direction: asin(-y), atan2(-x, -z) of its unit vector."""
    u = unit(v)
    return F.asin(-F.element_at(u, 2)), F.atan2(-F.element_at(u, 1), -F.element_at(u, 3))


def pixel_vector(pitch: Column, yaw: Column, image_width: Column) -> tuple[Column, Column]:
    """Image vector of a direction, a fifth of the image width long, truncated to whole pixels."""
    length = image_width / 5
    return (-length * F.sin(yaw) * F.cos(pitch)).cast("int"), (-length * F.sin(pitch)).cast("int")


def euler_matrix(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Rotation Ry(yaw) . Rp(pitch) . Rr(roll) from angles in degrees, as an array of rows."""
    cy, sy, cp, sp, cr, sr = (f(F.radians(x)) for x in (yaw, pitch, roll) for f in (F.cos, F.sin))
    one, zero = F.lit(1.0), F.lit(0.0)
    ry = [[cy, zero, sy], [zero, one, zero], [-sy, zero, cy]]
    rp = [[cp, -sp, zero], [sp, cp, zero], [zero, zero, one]]
    rr = [[one, zero, zero], [zero, cr, -sr], [zero, sr, cr]]
    mul = lambda x, y: [[reduce(lambda p, q: p + q, (x[i][k] * y[k][j] for k in range(3))) for j in range(3)] for i in range(3)]
    return F.array(*(F.array(*row) for row in mul(mul(ry, rp), rr)))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); corners in any order; NULL for two empty boxes or a NULL corner."""

    def ordered(v: list[Column]) -> list[Column]:
        return [F.least(v[0], v[2]), F.least(v[1], v[3]), F.greatest(v[0], v[2]), F.greatest(v[1], v[3])]

    p, q = ordered(a), ordered(b)
    wide = F.greatest(F.lit(0.0), F.least(p[2], q[2]) - F.greatest(p[0], q[0]))
    tall = F.greatest(F.lit(0.0), F.least(p[3], q[3]) - F.greatest(p[1], q[1]))
    both = wide * tall
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    known = reduce(lambda x, y: x & y, (c.isNotNull() for c in (*a, *b)))
    return F.when(known, F.try_divide(both, area(p) + area(q) - both))


def strict_mean(x: Column) -> Column:
    """Mean that any missing value makes missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def strict_mean_of(x: Column, rows: Column) -> Column:
    """``strict_mean`` over the rows for which a condition holds."""
    return F.when(F.count(F.when(rows, x)) == F.count_if(rows), F.avg(F.when(rows, x)))


def strict_least(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
