"""Scalar and aggregate expressions with the engine's rules for missing values: null is missing, and a division by zero gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def strict_median(v: Column) -> Column:
    """Median that is null if any value is."""
    return F.when(F.count(F.lit(1)) == F.count(v), F.median(v))


def between(lo: Column, hi: Column, share: Column) -> Column:
    """lo * (1 - share) + hi * share, the first product taken with its rounding error (as a fused multiply-add has it, and the engine's quantiles).

    So of two neighbouring values it gives one of the two, and of two equal ones that value; the plain sum can be less than both, and a row at the quantile would lie above it.
    """
    rest = 1 - share
    halves = lambda a: (lambda high: (high, a - high))(a * 134217729.0 - (a * 134217729.0 - a))
    (ah, al), (bh, bl) = halves(lo), halves(rest)
    p, q = lo * rest, hi * share
    lost = ah * bh - p + ah * bl + al * bh + al * bl
    s = p + q
    carried = (p - (s - (s - p))) + (q - (s - p))
    return F.when(F.abs(lo).between(1e-200, 1e200), s + (carried + lost)).otherwise(s)


def pearson(t: Column, p: Column) -> Column:
    return safe_div(F.covar_pop(t, p), F.stddev_pop(t) * F.stddev_pop(p))


def r2(t: Column, p: Column) -> Column:
    """1 - SSres/SStot; on constant truth 1 if exact, else 0; null under two rows. Rows without a truth don't count."""
    n = F.count(t)
    residual, total = F.sum((t - p) * (t - p)), F.var_pop(t) * n
    return F.when(n < 2, None).when(total == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - safe_div(residual, total))


def euclid(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def angle(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx) + F.pi()


def mish(x: Column) -> Column:
    return x * F.tanh(F.when(x > 20, x).otherwise(F.log1p(F.exp(x))))


def poly_rate(start: float, epoch: Column, epochs: int, power: float = 0.9) -> Column:
    return F.lit(start) * F.pow(1 - epoch / F.lit(float(epochs)), F.lit(power))


def clip(v: Column, bound: Column) -> Column:
    """Into [-bound, bound]; null stays null."""
    return F.when(v.isNull(), None).when(v > bound, bound).when(v < -bound, -bound).otherwise(v)


def whole_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))
