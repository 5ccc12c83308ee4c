"""Model quantities and vector functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PI = math.pi


def uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) that any engine with MD5 gives alike."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def radius(dim: int, n: float) -> float:
    """R of the D-sphere that N vertices cover at unit density."""
    return n / (2 * PI) if dim == 1 else (n * math.gamma((dim + 1) / 2) / (2 * PI ** ((dim + 1) / 2))) ** (1 / dim)


def density(dim: int, beta: float, mean_degree: float) -> float:
    """mu, which sets the mean degree."""
    return beta * math.gamma(dim / 2) * math.sin(dim * PI / beta) / (2 * PI ** (1 + dim / 2) * mean_degree)


def circular_distance(a: Column, b: Column) -> Column:
    return F.lit(PI) - F.abs(F.lit(PI) - F.abs(a - b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))


def angle(a: Column, b: Column, tiny: float = 1e-10) -> Column:
    c = dot(a, b) / (norm(a) * norm(b))
    return F.when(F.abs(c - 1) < tiny, F.lit(0.0)).otherwise(F.acos(clamped(c)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def chi(distance: Column, ka: Column, kb: Column, dim: int, big_r: float, mu: float) -> Column:
    return F.lit(big_r) * distance / F.pow(F.lit(mu) * ka * kb, F.lit(1.0 / dim))


def probability(x: Column, beta: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(x, F.lit(beta)))


def hyperbolic_radius(kappa: Column, kappa_min: float, dim: int, n: float, mu: float, shift: float = 0.0) -> Column:
    """R_H - (2 / D) ln(kappa / kappa_min)."""
    big = 2 * math.log(2 * radius(dim, n) / (mu * kappa_min**2) ** (1 / dim)) if dim > 1 else 2 * math.log(n / (PI * mu * kappa_min**2))
    return F.lit(big + shift) - F.lit(2.0 / dim) * F.log(kappa / F.lit(kappa_min))


def hyperbolic_distance(ra: Column, rb: Column, delta: Column) -> Column:
    inside = ((F.lit(1.0) - F.cos(delta)) * F.cosh(ra + rb) + (F.lit(1.0) + F.cos(delta)) * F.cosh(ra - rb)) / 2
    return F.when(delta == 0, F.abs(ra - rb)).otherwise(F.acosh(F.greatest(F.lit(1.0), inside)))


def chord(distance: Column) -> Column:
    return F.lit(2.0) * F.sin(distance / 2)


def wrap(theta: Column) -> Column:
    return F.pmod(theta, F.lit(2 * PI))


def scaled(v: Column, length: float) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x * F.lit(length) / n)


def rotate_axis_to(axis: Column, target: Column, x: Column) -> Column:
    """x turned by half a turn about axis + target: takes the unit axis to the unit target."""
    s = F.zip_with(axis, target, lambda a, b: a + b)
    f = F.lit(2.0) * dot(s, x) / dot(s, s)
    return F.zip_with(s, x, lambda a, b: a * f - b)


def apply_rows(matrix: list[list[float]], x: Column) -> Column:
    return F.array(*(dot(F.array(*(F.lit(float(v)) for v in row)), x) for row in matrix))


def to_hyperspherical(v: Column, dim: int) -> Column:
    """dim angles of a (dim + 1)-vector; the last in [0, 2 pi)."""
    tail = [F.sqrt(sum((v[j] * v[j] for j in range(i + 1, dim + 1)), v[i] * v[i])) for i in range(dim)]
    angles = [F.when(tail[i] == 0, F.lit(0.0)).otherwise(F.acos(clamped(v[i] / tail[i]))) for i in range(dim)]
    angles[-1] = F.when(v[dim] < 0, F.lit(2 * PI) - angles[-1]).otherwise(angles[-1])
    return F.array(*angles)


def to_cartesian(angles: Column, dim: int, length: float = 1.0) -> Column:
    out, sines = [], F.lit(length)
    for i in range(dim):
        out.append(sines * F.cos(angles[i]))
        sines = sines * F.sin(angles[i])
    return F.array(*out, sines)


def slerp(a: Column, b: Column, steps: int = 50, w: Column | None = None) -> Column:
    """Points on the great circle from a to b, both of one length; w: their angle, where a column holds it already."""
    w = angle(a, b) if w is None else w

    def at(k: Column) -> Column:
        t = k / F.lit(steps - 1.0)
        return F.when(w < 1e-12, a).otherwise(F.zip_with(a, b, lambda x, y: (F.sin((1 - t) * w) * x + F.sin(t * w) * y) / F.sin(w)))

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), at)


def _once(drawn: Column, f) -> Column:
    """f of drawn numbers, which are drawn once a row however often f names them."""
    return F.transform(F.array(drawn), f)[0]


def random_direction(dim: int, seed: int) -> Column:
    """A uniform point of the unit D-sphere."""
    return _once(F.array(*(F.randn(seed + i) for i in range(dim + 1))), lambda v: scaled(v, 1.0))


def random_at_angle(dim: int, distance: Column, seed: int) -> Column:
    """A random unit vector at an angle from the first axis."""
    side = _once(F.array(*(F.randn(seed + i) for i in range(dim))), lambda v: scaled(v, 1.0))
    return F.concat(F.array(F.cos(distance)), F.transform(side, lambda x: x * F.sin(distance)))


def power_law(u: Column, n: float, gamma: float, mean_degree: float) -> Column:
    """Bounded Pareto hidden degrees."""
    k0 = (1 - 1 / n) / (1 - n ** ((2 - gamma) / (gamma - 1))) * (gamma - 2) / (gamma - 1) * mean_degree
    kc = k0 * n ** (1 / (gamma - 1))
    return F.lit(k0) * F.pow(F.lit(1.0) - u * F.lit(1 - (kc / k0) ** (1 - gamma)), F.lit(1 / (1 - gamma)))


def register(spark: SparkSession) -> None:
    """The pairwise quantities as SQL functions."""
    for name, args, body in (
        ("hs_circular_distance", "a DOUBLE, b DOUBLE", "pi() - abs(pi() - abs(a - b))"),
        ("hs_chi", "d DOUBLE, ka DOUBLE, kb DOUBLE, dim INT, big_r DOUBLE, mu DOUBLE", "big_r * d / pow(mu * ka * kb, 1.0D / dim)"),
        ("hs_probability", "x DOUBLE, beta DOUBLE", "1.0D / (1.0D + pow(x, beta))"),
        ("hs_hyperbolic_distance", "ra DOUBLE, rb DOUBLE, d DOUBLE", "CASE WHEN d = 0 THEN abs(ra - rb) ELSE acosh(greatest(1.0D, ((1 - cos(d)) * cosh(ra + rb) + (1 + cos(d)) * cosh(ra - rb)) / 2)) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
