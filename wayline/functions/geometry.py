"""Vectors, quaternions (w, x, y, z; Hamilton) and rotations as tuples of columns.

Everything is plain column arithmetic, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
Mat = tuple[Vec, Vec, Vec]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda x, y: x + y, (p * q for p, q in zip(a, b, strict=True)))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def finite(*cols: Column) -> Column:
    """True where every value is neither null, NaN nor infinite."""
    return reduce(lambda x, y: x & y, (c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cols))


def scrub(x: Column, high: float) -> Column:
    """NaN and null become 0, infinities +-high."""
    return F.when(x.isNull() | F.isnan(x), 0.0).when(x == float("inf"), high).when(x == float("-inf"), -high).otherwise(x)


def bound(values: Vec, *steps) -> Vec:
    """values taken through steps (function of a tuple of columns, number of its results), each computed once.

    Without it every mention of a column repeats its whole expression, and chains of such functions grow
    out of all proportion.
    """

    def taken(rows: Column, f, n: int) -> Column:
        return F.transform(rows, lambda r: F.array(*f(tuple(r[i] for i in range(n)))))

    rows, n = F.array(F.array(*values)), len(values)
    for f, size in steps:
        rows, n = taken(rows, f, n), size
    row = F.element_at(rows, 1)
    return tuple(row[i] for i in range(n))


def q_normalize(q: Vec) -> Vec:
    """Unit quaternion; one shorter than 1e-12 is an error when evaluated."""
    n = norm(q)
    checked = F.when(n < 1e-12, F.raise_error(F.lit("quaternion norm is near zero")).cast("double")).otherwise(n)
    return scale(q, 1.0 / checked)


def q_conjugate(q: Vec) -> Vec:
    return (q[0], -q[1], -q[2], -q[3])


def q_product(a: Vec, b: Vec) -> Vec:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def q_multiply(a: Vec, b: Vec) -> Vec:
    """Product of the normalized arguments, normalized again."""
    return bound(a + b, (lambda v: q_product(q_normalize(v[:4]), q_normalize(v[4:])), 4), (q_normalize, 4))


def q_matrix(q: Vec) -> Mat:
    def entries(v: Vec) -> Vec:
        w, x, y, z = v
        return (
            *(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
            *(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
            *(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
        )

    m = bound(q, (q_normalize, 4), (entries, 9))
    return (m[:3], m[3:6], m[6:])


def q_from_matrix(m: Mat) -> Vec:
    """Quaternion of a rotation, by the largest of the four diagonal sums; w >= 0."""

    def largest(v: Vec) -> Vec:
        a, b, c, d, e, f, g, h, i = v
        trace = a + e + i
        place = F.when(trace > 0, 0).when((a > e) & (a > i), 1).when(e > i, 2).otherwise(3)
        # four times the products of each two components: a row of them is the quaternion times one of its own
        rows = ((1 + trace, h - f, c - g, d - b), (h - f, 1 + a - e - i, b + d, c + g), (c - g, b + d, 1 - a + e - i, f + h), (d - b, c + g, f + h, 1 - a - e + i))
        return tuple(F.element_at(F.array(*(row[k] for row in rows)), place + 1) for k in range(4))

    def unit(q: Vec) -> Vec:
        return scale(q_normalize(q), F.when(q[0] < 0, -1.0).otherwise(1.0))

    return bound(tuple(x for row in m for x in row), (largest, 4), (unit, 4))


def m_apply(m: Mat, v: Vec) -> Vec:
    return tuple(dot(row, v) for row in m)


def m_transpose(m: Mat) -> Mat:
    return tuple(zip(*m, strict=True))


def m_product(a: Mat, b: Mat) -> Mat:
    return tuple(tuple(dot(row, col) for col in m_transpose(b)) for row in a)


def constant(m) -> Mat:
    """A matrix (or vector) of numbers as literals."""
    return tuple(constant(r) if hasattr(r, "__len__") else F.lit(float(r)) for r in m)


def rotate(q: Vec, v: Vec) -> Vec:
    """v turned by q, by two cross products."""

    def turned(x: Vec) -> Vec:
        w, u, p = x[0], x[1:4], x[4:]
        t = scale(cross(u, p), 2.0)
        return add(add(p, scale(t, w)), cross(u, t))

    return bound(tuple(q) + tuple(v), (lambda x: q_normalize(x[:4]) + x[4:], 7), (turned, 3))


def q_slerp(a: Vec, b: Vec, t) -> Vec:
    """Interpolation along the shorter way; nearly equal arguments are mixed linearly."""

    def units(v: Vec) -> Vec:
        return q_normalize(v[:4]) + q_normalize(v[4:])

    def nearer(v: Vec) -> Vec:
        d = dot(v[:4], v[4:])
        return (*v[:4], *scale(v[4:], F.when(d < 0, -1.0).otherwise(1.0)), clip(F.abs(d), -1.0, 1.0))

    def mixed(v: Vec) -> Vec:
        angle, near = F.acos(v[8]), v[8] > 0.9995
        s = F.when(F.sin(angle) == 0, 1.0).otherwise(F.sin(angle))
        ka = F.when(near, 1.0 - t).otherwise(F.sin((1.0 - t) * angle) / s)
        kb = F.when(near, F.lit(t)).otherwise(F.sin(t * angle) / s)
        return add(scale(v[:4], ka), scale(v[4:8], kb))

    return bound(a + b, (units, 8), (nearer, 9), (mixed, 4), (q_normalize, 4))


def q_euler(q: Vec) -> Vec:
    """Roll, pitch and yaw in degrees (Z-Y-X), pitch clamped at the poles."""
    w, x, y, z = q
    roll = F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)))
    pitch = F.degrees(F.asin(clip(2 * (w * y - z * x), -1.0, 1.0)))
    yaw = F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))
    return (roll, pitch, yaw)


def q_angle(a: Vec, b: Vec) -> Column:
    """Geodesic angle between two unit quaternions in degrees; the sign of either is no matter."""
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def levelling(accel: Vec) -> Vec:
    """Quaternion with the roll and pitch that a mean specific force at rest shows; yaw is 0."""
    ax, ay, az = accel
    roll, pitch = F.atan2(-ay, -az), F.atan2(ax, F.sqrt(ay * ay + az * az))
    cr, sr, cp, sp = F.cos(roll / 2), F.sin(roll / 2), F.cos(pitch / 2), F.sin(pitch / 2)
    return (cr * cp, sr * cp, cr * sp, -sr * sp)


def camera_to_body(rotation: Mat, offset: Vec, p: Vec) -> Vec:
    return add(m_apply(rotation, p), offset)


def body_to_camera(rotation: Mat, offset: Vec, p: Vec) -> Vec:
    return m_apply(m_transpose(rotation), sub(p, offset))


def direction_to_body(rotation: Mat, d: Vec) -> Vec:
    out = m_apply(rotation, d)
    n = norm(out)
    return scale(out, 1.0 / F.when(n < 1e-12, 1.0).otherwise(n))


def relative_to_body(rotation: Mat, r: Mat) -> Mat:
    return m_product(m_product(rotation, r), m_transpose(rotation))


def invert_transform(rotation: Mat, offset: Vec) -> tuple[Mat, Vec]:
    back = m_transpose(rotation)
    return back, scale(m_apply(back, offset), -1.0)


def parallax(centre_a: Vec, centre_b: Vec, point: Vec) -> Column:
    """Angle in degrees under which a point sees two centres; 0 where it lies on one."""
    a, b = sub(point, centre_a), sub(point, centre_b)
    na, nb = norm(a), norm(b)
    cosine = dot(a, b) / F.when(na * nb == 0, 1.0).otherwise(na * nb)
    return F.when((na < 1e-6) | (nb < 1e-6), 0.0).otherwise(F.degrees(F.acos(clip(cosine, -1.0, 1.0))))


def project(p: Vec, fx: float, fy: float, cx: float, cy: float, k1=0.0, k2=0.0, p1=0.0, p2=0.0) -> Vec:
    """Pixel of a camera-frame point by the pinhole model with radial and tangential distortion."""
    x, y = p[0] / p[2], p[1] / p[2]
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    xd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    yd = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return (fx * xd + cx, fy * yd + cy)


def undistort(u: Column, v: Column, fx: float, fy: float, cx: float, cy: float, k1=0.0, k2=0.0, p1=0.0, p2=0.0, rounds: int = 8) -> Vec:
    """Normalized coordinates of a pixel, by fixed-point steps (unrolled)."""
    x0, y0 = (u - cx) / fx, (v - cy) / fy
    state = F.struct(x0.alias("x"), y0.alias("y"))

    def step(s, _):
        x, y = s["x"], s["y"]
        r2 = x * x + y * y
        radial = 1 + k1 * r2 + k2 * r2 * r2
        return F.struct(((x0 - 2 * p1 * x * y - p2 * (r2 + 2 * x * x)) / radial).alias("x"), ((y0 - p1 * (r2 + 2 * y * y) - 2 * p2 * x * y) / radial).alias("y"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step)
    return (out["x"], out["y"])
