"""Expressions over one waveform array. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row. An expression used
    inside a lambda would otherwise be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def centred(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def sd(a: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(sum_squares(centred(a)) / F.size(a))


def diffs(a: Column) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1), lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; 0 when one is constant, missing, too short or
    of another length."""

    def scaled(x: Column, y: Column) -> Column:
        den = F.sqrt(sum_squares(x) * sum_squares(y))
        return let(den, lambda d: F.when(d > 1e-12, dot(x, y) / d))

    r = let(centred(a), lambda x: let(centred(b), lambda y: scaled(x, y)))
    ok = (F.size(a) == F.size(b)) & (F.size(a) >= 2)
    return F.coalesce(F.when(ok, r), F.lit(0.0))


def quantile(sorted_a: Column, p: float) -> Column:
    """Linear interpolation in an already sorted array."""
    h = (F.size(sorted_a) - 1) * F.lit(float(p))
    lo = F.floor(h).cast("int")
    a = F.element_at(sorted_a, lo + 1)
    b = F.element_at(sorted_a, F.least(lo + 2, F.size(sorted_a)))
    return a + (b - a) * (h - lo)


def zscore(a: Column, eps: float = 1e-8) -> Column:
    return let(mean(a), lambda m: let(sd(a), lambda s: F.transform(a, lambda x: (x - m) / (s + eps))))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def argmax_abs(a: Column) -> Column:
    """0-based index of the first largest magnitude."""
    m = F.transform(a, F.abs)
    return (F.array_position(m, F.array_max(m)) - 1).cast("int")


def padded_window(a: Column, centre: Column, length: int) -> Column:
    """``length`` values around the 0-based ``centre``; 0 beyond the ends."""
    start = centre - length // 2
    idx = F.sequence(start, start + length - 1)
    inside = lambda i: F.when((i >= 0) & (i < F.size(a)), F.get(a, i.cast("int")))
    return F.transform(idx, lambda i: F.coalesce(inside(i), F.lit(0.0)))


def snap(a: Column, centre: Column, radius: int) -> Column:
    """0-based index of the first largest magnitude within ``radius``."""
    lo = F.greatest(F.lit(0), centre - radius)
    hi = F.least(F.size(a) - 1, centre + radius)
    return (lo + argmax_abs(F.slice(a, lo + 1, hi - lo + 1))).cast("int")


def reconstruction_snr(original: Column, rebuilt: Column, cap: float = 60.0) -> Column:
    """10 log10 of signal variance over residual variance, at most ``cap``."""
    resid = F.zip_with(original, rebuilt, lambda x, y: x - y)
    vs, vr = F.pow(sd(original), 2), F.pow(sd(resid), 2)
    return F.when(vr < 1e-12, F.lit(cap)).otherwise(F.least(F.lit(cap), 10 * F.log10(vs / vr)))


def rr_pattern(a: Column, share: float = 0.65, change_ms: float = 200.0) -> Column:
    """ramp_up: most steps fall and the total fall is large; recovery: the
    reverse; else an empty string."""
    d = diffs(a)
    n = F.size(d)
    falling = F.size(F.filter(d, lambda x: x < 0)) / n
    rising = F.size(F.filter(d, lambda x: x > 0)) / n
    fall = F.element_at(a, 1) - F.element_at(a, -1)
    return (
        F.when((falling > share) & (fall > change_ms), "pots_ramp_up")
        .when((rising > share) & (-fall > change_ms), "pots_recovery")
        .otherwise("")
    )
