"""Row-wise expressions: distances, angles, segments, weights, array smoothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclid(x1, y1, x2, y2) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def chebyshev(x1, y1, x2, y2) -> Column:
    return F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))


def cityblock(x1, y1, x2, y2) -> Column:
    return F.abs(x2 - x1) + F.abs(y2 - y1)


def scaled_chebyshev(px, py, sx, sy, beta) -> Column:
    """Distance to a site that stretches by ``beta`` along x and shrinks by it along y."""
    return F.greatest(F.abs(px - sx) * beta, F.abs(py - sy) / beta)


def angle_to(x1, y1, x2, y2) -> Column:
    """Direction from the first point to the second, in degrees (-180, 180]."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def angle_deg(gx: Column, gy: Column) -> Column:
    """Gradient direction in (0, 360]; null when both parts vanish (|v| <= 1e-10)."""
    cx = F.when(F.abs(gx) > 1e-10, gx).otherwise(0.0)
    cy = F.when(F.abs(gy) > 1e-10, gy).otherwise(0.0)
    return F.when((cx != 0) | (cy != 0), F.degrees(F.atan2(cy, cx)) + 180.0)


def wrap_degrees(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def segment_end(x, y, angle, length) -> tuple[Column, Column]:
    rad = F.radians(angle)
    return x + length * F.cos(rad), y + length * F.sin(rad)


def round_half_away(col: Column) -> Column:
    return (F.signum(col) * F.floor(F.abs(col) + 0.5)).cast("long")


def order_of_magnitude(col: Column) -> Column:
    """Truncated log10 of the absolute value; null for zero."""
    return F.when(col != 0, F.log10(F.abs(col)).cast("int"))


def edge_weight_from_mass(mass: Column) -> Column:
    """-1 / ln p, with its limits 0 at p = 0 and infinity at p = 1."""
    return (
        F.when(mass <= 0, F.lit(0.0))
        .when(mass >= 1, F.lit(float("inf")))
        .otherwise(F.try_divide(F.lit(-1.0), F.log(mass)))
    )


def edge_weight_from_two_masses(a: Column, b: Column) -> Column:
    """Older form of the weight: the logarithm of the summed masses."""
    return F.log(a + b)


def gravity_weight(m1, m2, squared_distance) -> Column:
    return F.try_divide(m1 * m2, squared_distance)


def density(n: Column, m: Column) -> Column:
    return F.when(n > 1, F.try_divide(2.0 * m, n * (n - 1))).otherwise(F.lit(0.0))


def sparsity(nonzero: Column, n: Column) -> Column:
    return nonzero / (n * n)


def reduce_spikes(arr: Column, times: int = 10) -> Column:
    """Replace the largest entry by the mean of its neighbours, ``times`` times over."""

    def at(a, i):
        return F.element_at(a, i.cast("int"))

    def once(a, _):
        peak = F.array_position(a, F.array_max(a))
        size = F.size(a).cast("long")
        left = F.when(peak == 1, at(a, size)).otherwise(at(a, F.greatest(peak - 1, F.lit(1))))
        right = F.when(peak == size, at(a, F.lit(1))).otherwise(
            at(a, F.least(peak + 1, size))
        )
        mean = (left + right) / 2.0
        return F.transform(a, lambda v, i: F.when(i + 1 == peak, mean).otherwise(v))

    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), arr, once)


def moving_average_array(arr: Column, width: int, circular: bool = True) -> Column:
    """Box filter of odd ``width`` over an array; wraps round, or drops the partial ends."""
    if width == 1:
        return arr
    half = width // 2
    size = F.size(arr)
    padded = (
        F.concat(F.slice(arr, size - half + 1, half), arr, F.slice(arr, 1, half))
        if circular
        else arr
    )
    out = F.sequence(F.lit(1), size if circular else size - width + 1)
    return F.transform(
        out,
        lambda i: F.aggregate(
            F.slice(padded, i, F.lit(width)), F.lit(0.0), lambda s, v: s + v
        )
        / float(width),
    )


def chi2_distance(a: Column, b: Column) -> Column:
    """Half chi-square distance of two histograms held as arrays; eps keeps empty bins finite."""
    eps = 2.220446049250313e-16
    terms = F.zip_with(
        a, b, lambda p, q: (p - q) * (p - q) / ((p + eps) + (q + eps))
    )
    return 0.5 * F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def modular_hash(parts: list[Column], modulus) -> Column:
    """Seeded draw in [0, modulus) from the first 32 bits of an MD5, the same on any engine."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), modulus)


def log_grid(lo: float, hi: float, n: int) -> list[float]:
    """``n`` points from 10**lo to 10**hi, evenly spaced in the exponent."""
    step = (hi - lo) / (n - 1)
    return [10.0 ** (lo + i * step) for i in range(n)]


def linear_grid(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def literal_array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def mapped(x: Column, low: Column, high: Column, to_low: Column, to_high: Column) -> Column:
    """The affine map that takes ``low`` to ``to_low`` and ``high`` to ``to_high``; null where both are one."""
    return to_low + F.try_divide((x - low) * (to_high - to_low), high - low)
