"""Array expressions over short series (a session's bars): differences, moments, folds, runs.

Everything stays a native expression on ``array<double>`` columns; the arrays
are bounded by the bars of one session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def null() -> Column:
    return F.lit(None).cast("double")



def at(a: Column, i: Column | int) -> Column:
    """Element by zero-based index, null outside."""
    return F.try_element_at(a, (F.lit(i) if isinstance(i, int) else i).cast("int") + 1)


def part(a: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` elements from a zero-based start; empty where there are none."""
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.slice(a, start.cast("int") + 1, F.greatest(F.lit(0), length.cast("int")))


def lagged(a: Column, k: int | Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(a[i], a[i - k]) for all i that have both."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.greatest(F.lit(0), F.size(a) - k)
    return F.zip_with(part(a, k, n), part(a, 0, n), f)


def diff(a: Column, k: int | Column = 1) -> Column:
    return lagged(a, k, lambda x, y: x - y)


def log(a: Column) -> Column:
    return F.transform(a, lambda x: F.log(x))


def total(a: Column) -> Column:
    """Sum, zero for none."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def variance(a: Column, ddof: int = 1) -> Column:
    """Null for too few values."""
    m = mean(a)
    square = F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > ddof, square / (F.size(a) - ddof))


def std(a: Column, ddof: int = 1) -> Column:
    return F.sqrt(variance(a, ddof))


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (at(s, F.floor((n - 1) / 2)) + at(s, F.floor(n / 2))) / 2)


def count(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, test))


def share(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_divide(count(a, test).cast("double"), F.size(a).cast("double"))


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def flips(a: Column) -> Column:
    """Sign changes between neighbours among the non-zero elements."""
    signs = F.filter(F.transform(a, sign), lambda x: x != 0)
    return count(lagged(signs, 1, lambda x, y: x * y), lambda x: x < 0)


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held between two bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def smooth(a: Column, period: int, kind: str, start: int | None = None) -> Column:
    """Recursive smoothing, as long as ``a``: null up to the seed over the first ``period`` values after leading nulls, or from index ``start`` on.

    ``sum`` (Wilder, sum form), ``ema`` (sum form) or ``mean`` (Wilder,
    average form). The seed skips nulls; a null later on makes all after it null.
    """
    if start is None:
        lead = F.coalesce(F.array_position(F.transform(a, lambda x: x.isNotNull()), F.lit(True)) - 1, F.lit(0)).cast("int")
        lead = F.when(lead < 0, F.size(a)).otherwise(lead)
    else:
        lead = F.lit(start)
    body = part(a, lead, F.size(a) - lead)
    first = present(part(body, 0, period))
    seed = mean(first) if kind == "mean" else total(first)
    alpha = 2.0 / (period + 1)
    steps = {"sum": lambda s, x: s - s / period + x, "ema": lambda s, x: x * alpha * period + s * (1 - alpha), "mean": lambda s, x: s * (1 - 1 / period) + x / period}
    run = F.aggregate(part(body, period, F.size(body) - period), F.array(seed), lambda out, x: F.array_append(out, steps[kind](F.element_at(out, -1), x)))
    return F.when(F.size(body) >= period, F.concat(F.array_repeat(null(), lead + period - 1), run)).otherwise(F.array_repeat(null(), F.size(a)))


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y over x (arrays of one length)."""
    mx, my = mean(x), mean(y)
    xy = total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    return F.try_divide(xy, total(F.transform(x, lambda a: (a - mx) * (a - mx))))


def frames(a: Column, width: int | Column, f: Callable[[Column], Column]) -> Column:
    """f of each complete window of ``width`` elements."""
    width = F.lit(width) if isinstance(width, int) else width
    n = F.size(a) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: f(part(a, i, width)))).otherwise(F.array().cast("array<double>"))


def range_maxima(a: Column) -> Column:
    """Maxima over 1, 2, 4, ... elements from each on (an array per power, as far as there are so many): n log n values."""
    n = F.size(a)

    def doubled(levels: Column, k: Column) -> Column:
        last, half = F.element_at(levels, -1), F.pow(F.lit(2.0), k - 1).cast("int")
        m = n - 2 * half + 1
        return F.concat(levels, F.array(F.zip_with(part(last, 0, m), part(last, half, m), lambda x, y: F.greatest(x, y))))

    top = F.floor(F.log2(n.cast("double"))).cast("int")
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), top), F.array(a), doubled)).otherwise(F.array(a))


def next_greater(a: Column, maxima: Column) -> Column:
    """The index of the next greater element of each, null without one; ``maxima`` are the column's ``range_maxima``.

    Leaps of falling powers of two over what is not greater: log n steps an element. Nulls are leapt over.
    """
    n = F.size(a)

    def search(x: Column, i: Column) -> Column:
        def leap(pos: Column, k: Column) -> Column:
            wide = F.pow(F.lit(2.0), k).cast("int")
            over = (pos + wide <= n) & F.coalesce(F.try_element_at(F.element_at(maxima, k + 1), pos + 1) <= x, F.lit(True))
            return F.when(over, pos + wide).otherwise(pos)

        end = F.aggregate(F.sequence(F.size(maxima) - 1, F.lit(0), F.lit(-1)), i + 1, leap)
        return F.when(end < n, end)

    return F.transform(a, search)
