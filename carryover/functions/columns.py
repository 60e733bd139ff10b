"""Column helpers.  All are compositions of built-in functions, so they stay
inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 97.5 % point of the standard normal distribution.
Z95 = 1.959963984540054


# What counts as a blank around a value: files with fixed widths or foreign line ends leave these.
BLANKS = " \t\r\n"


def trimmed(value: Column) -> Column:
    """A text without outer blanks."""
    return F.trim(value, F.lit(BLANKS))


def normalise(code: Column) -> Column:
    """A code as it is compared everywhere: no dots, no outer blanks, upper case."""
    return F.upper(trimmed(F.replace(code, F.lit("."), F.lit(""))))


def blank(code: Column) -> Column:
    return code.isNull() | (trimmed(code) == "")


def share(n: Column, d: Column, digits: int = 4) -> Column:
    """``n / d`` rounded half up at ``digits`` decimals, NULL when ``d`` is 0.

    Done on integers, because a rounded double differs between engines (and
    between partition orders, were it summed) exactly at the ties.
    """
    scale = 10**digits
    n, d = n.cast("long"), d.cast("long")
    units = F.call_function("div", n * F.lit(2 * scale) + d, d * F.lit(2))
    return F.when(d > 0, units.cast("double") / F.lit(float(scale)))


def signed_share(n: Column, d: Column, digits: int = 4, per: int = 1) -> Column:
    """:func:`share` for a numerator that may be negative, times ``per``."""
    size = share(F.abs(n) * F.lit(per), d, digits)
    return F.when(n < 0, -size).otherwise(size)


def integer_rate(n: Column, d: Column, scale: int) -> Column:
    """``n / d`` in whole units of ``1 / scale`` (a bigint), half up."""
    n, d = n.cast("long"), d.cast("long")
    return F.when(d > 0, F.call_function("div", n * F.lit(2 * scale) + d, d * F.lit(2)))


def ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def in_years(day: Column, first: int, last: int | None = None) -> Column:
    """A half-open date range.  Unlike ``year(day) = x`` it reaches the scan."""
    last = first if last is None else last
    low = F.lit(f"{first:04d}-01-01").cast("date")
    high = F.lit(f"{last + 1:04d}-01-01").cast("date")
    return (day >= low) & (day < high)


def mapped(value: Column, names: Mapping[str, str], default: str | None = None) -> Column:
    """Value looked up in a driver-side mapping; a CASE, not a join."""
    out = F.lit(default).cast("string")
    for key, name in reversed(list(names.items())):
        out = F.when(value == key, F.lit(name)).otherwise(out)
    return out


def byar(observed: Column, expected_units: Column, scale: int, side: str, digits: int = 4) -> Column:
    """One end of Byar's 95 % interval of observed over expected.

    ``expected_units`` is the expectation in whole units of ``1 / scale``; the
    interval is that of a count, and an expectation of zero has none.
    """
    n = observed.cast("double") + (0.0 if side == "low" else 1.0)
    spread = F.lit(Z95) / (F.sqrt(n) * 3.0)
    root = F.lit(1.0) - F.lit(1.0) / (n * 9.0) + (-spread if side == "low" else spread)
    end = F.when(n > 0, n * root * root * root).otherwise(0.0) / (expected_units.cast("double") / F.lit(float(scale)))
    return F.when(expected_units > 0, F.round(end, digits))


def wilson(n: Column, d: Column, side: str, digits: int = 4) -> Column:
    """One end of the 95 % Wilson interval of ``n`` successes in ``d`` trials."""
    n, d = n.cast("double"), d.cast("double")
    z2 = F.lit(Z95 * Z95)
    spread = F.lit(Z95) * F.sqrt(n * (d - n) / d + z2 / 4.0)
    middle = n + z2 / 2.0
    end = (middle - spread if side == "low" else middle + spread) / (d + z2)
    return F.when(d > 0, F.round(end, digits))
